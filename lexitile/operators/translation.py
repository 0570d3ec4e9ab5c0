"""Translating chunks through a pluggable model.

``translate_snapshot`` is set-based: blank and placeholder-only chunks pass through, known chunks come from the memory by a join,
each distinct remaining request reaches the model once, in batches of a partition. ``translate_sequential`` folds the chunks of a file
in order, so that a chunk can serve as the example of a later one; files run in parallel, and one file is one task by definition.

The model is a callable ``prompt -> reply`` shipped with the job; a raised ``Overloaded`` is tried again with doubled waiting times, a
reply that is no unit is asked again, at last from the stronger model.

Defined cases: NULL chunks have status 'null' and no text; blank chunks are returned as they are; failed chunks keep their
source text with status 'failed'; repeated requests get one answer.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from xml.etree.ElementTree import ParseError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitile.functions.markup import segment
from lexitile.functions.text import EXAMPLE_PROMPT, PLAIN_PROMPT, TOKENS, UNIT_PROMPT
from lexitile.functions.units import build, placeholder_only, reconstruct
from lexitile.operators.chunking import long_pieces

Model = Callable[[str], str]
#: Gate of examples, size of sub-chunks, attempts and waiting times.
EXAMPLE_GATE = 0.7
SUBCHUNK = 2000
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 1.0, 16.0


class Overloaded(Exception):
    """The model asks to wait."""


@dataclass
class Ladder:
    """Model calls with waiting and repetition."""

    model: Model
    stronger: Model | None = None
    attempts: int = ATTEMPTS
    first_wait: float = FIRST_WAIT
    longest_wait: float = LONGEST_WAIT
    sleep: Callable[[float], None] = time.sleep
    #: Seconds to rest after each answer.
    cooldown: float = 0.0
    #: Translatable string arguments by Typst function.
    typst_args: dict[str, list[str]] = field(default_factory=dict)

    def options(self, kind: str) -> dict:
        """Options of the scanner for a kind of chunk."""
        return {"args_by_function": self.typst_args} if kind == "typst" and self.typst_args else {}

    def patient(self, model: Model, prompt: str) -> str:
        wait = self.first_wait or 1.0
        for n in range(1, max(1, self.attempts) + 1):
            try:
                reply = model(prompt)
                if self.cooldown > 0:
                    self.sleep(self.cooldown)
                return reply
            except Overloaded:
                if n >= self.attempts:
                    raise
                self.sleep(min(wait, self.longest_wait))
                wait = min(2 * wait, self.longest_wait)
        raise AssertionError

    def unit(self, prompt: str, held: dict[str, str]) -> str:
        """The reply as text: the model twice, then the stronger one, while the reply is no unit."""
        for n, model in enumerate((self.model, self.model, self.stronger or self.model)):
            try:
                return reconstruct(reply_text(self.patient(model, prompt)), held)
            except ParseError:
                if n == 2:
                    raise
        raise AssertionError


def reply_text(reply: str) -> str:
    """As ``functions.text.reply_text``, on one string."""
    import re

    if "<output>" in reply:
        return "".join(re.findall(r"<output>\n?(.*?)(?:</output>|\Z)", reply, re.S))
    return "".join(re.findall(r"<document>.*?</document>", reply, re.S))


def unit_prompt(xml: str, kind: str, target: str, terms: str, example: tuple[str, str] | None) -> str:
    text = EXAMPLE_PROMPT if example else UNIT_PROMPT
    for name, value in (("content_type", kind), ("old_src", example[0] if example else ""), ("old_tgt", example[1] if example else ""), ("target", target), ("vocabulary", terms), ("src", xml)):
        text = text.replace(TOKENS[name], value)
    return text


def subchunks(text: str, limit: int = SUBCHUNK, **options) -> list[str]:
    """Parts of an oversized Typst chunk: segments packed up to the limit, only text is cut, other segments stand whole."""
    parts, held = [], ""
    for kind, content in segment(text, "typst", **options):
        for piece in long_pieces(content, limit) if kind == "text" and len(content) > limit else [content]:
            if held and len(held) + len(piece) > limit:
                parts.append(held)
                held = ""
            held += piece
    parts += [held] if held else []
    return parts if "".join(parts) == text else [text]


def translate_unit(ladder: Ladder, text: str, kind: str, target: str, terms: str = "", example: tuple[str, str] | None = None) -> str:
    xml, held = build(segment(text, kind, **ladder.options(kind)))
    return ladder.unit(unit_prompt(xml, kind, target, terms, example), held)


def parts_of(ladder: Ladder, text: str, kind: str) -> list[str]:
    """The parts in which a chunk is translated: several for oversized Typst."""
    return subchunks(text, **ladder.options(kind)) if kind == "typst" and len(text) > SUBCHUNK else [text]


def translate_chunk(ladder: Ladder, text: str, kind: str, target: str, terms: str = "", example: tuple[str, str] | None = None) -> str:
    """One chunk without the memory: oversized Typst in parts, everything else as one unit."""
    parts = parts_of(ladder, text, kind)
    if len(parts) == 1:
        return translate_unit(ladder, text, kind, target, terms, example)
    return "".join(p if passes_through(p, kind, ladder) else translate_unit(ladder, p, kind, target, terms) for p in parts)


def passes_through(text: str, kind: str, ladder: Ladder | None = None) -> bool:
    options = ladder.options(kind) if ladder else {}
    return not text.strip() or kind in ("code", "python", "java", "rust") or placeholder_only(segment(text, kind, **options), kind == "typst")


def translate_snapshot(chunks: DataFrame, memory: DataFrame, ladder: Ladder, terms: str = "") -> DataFrame:
    """``chunk_id, translated, from_cache, status``.

    ``chunks``: ``chunk_id, path, src_lang, tgt_lang, kind, content``; ``memory``: ``path, src_lang, tgt_lang, content, translated`` with
    path '' for any path. Each distinct request is translated once; the answers join back by its checksum.
    """
    key = ["path", "src_lang", "tgt_lang", "sum"]
    c = chunks.withColumn("path", F.coalesce("path", F.lit(""))).withColumn("sum", F.sha2("content", 256))
    m = memory.select("path", "src_lang", "tgt_lang", F.sha2("content", 256).alias("sum"), "translated").groupBy(*key).agg(F.min("translated").alias("known"))
    anywhere = m.where("path = ''").select("src_lang", "tgt_lang", "sum", F.col("known").alias("wild"))
    c = c.join(m, key, "left").join(anywhere, ["src_lang", "tgt_lang", "sum"], "left").withColumn("known", F.when(F.col("src_lang") != F.col("tgt_lang"), F.coalesce("known", "wild"))).drop("wild")
    asked = c.where("known is null and content is not null").select("path", "src_lang", "tgt_lang", "sum", "kind", "content").dropDuplicates([*key, "kind"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if passes_through(r.content, r.kind, ladder):
                    rows.append((r.content, "passed"))
                    continue
                try:
                    rows.append((translate_chunk(ladder, r.content, r.kind, r.tgt_lang, terms), "translated"))
                except Exception:  # noqa: BLE001 - any failure of a model is the status of its row
                    rows.append((r.content, "failed"))
            yield b[[*key, "kind"]].assign(answer=[x[0] for x in rows], how=[x[1] for x in rows])

    answers = asked.mapInPandas(run, "path string, src_lang string, tgt_lang string, sum string, kind string, answer string, how string")
    full = c.join(answers, [*key, "kind"], "left")
    status = F.when(F.col("content").isNull(), "null").when(F.col("known").isNotNull(), "cached").otherwise(F.col("how"))
    return full.select("chunk_id", F.coalesce("known", "answer").alias("translated"), status.isin("cached", "passed").alias("from_cache"), status.alias("status"))


def translate_plain(docs: DataFrame, id_col: str, text_col: str, ladder: Ladder, source: str | None, target: str, terms: str = "", lines: int = 50) -> DataFrame:
    """``id_col, translated, status`` of documents without markup: blocks of lines with the plain prompt, blank blocks kept, no memory.

    A failed block fails the document, which keeps its text; NULL texts have status 'null'.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def one(text: str) -> str:
        rows = text.splitlines(keepends=True)
        blocks = ["".join(rows[i : i + lines]) for i in range(0, len(rows), lines)] if lines > 0 else [text]
        out = []
        for b in blocks:
            prompt = PLAIN_PROMPT.replace(TOKENS["content_type"], "document")
            if source:
                prompt = prompt.replace(TOKENS["source"], source)
            prompt = prompt.replace(TOKENS["target"], target).replace(TOKENS["vocabulary"], terms)
            out.append(reply_text(ladder.patient(ladder.model, f"{prompt}\n<document>\n{b}\n</document>")) if b.strip() else b)
        return "".join(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                try:
                    rows.append((i, one(text), "translated") if text is not None else (i, None, "null"))
                except Exception:  # noqa: BLE001
                    rows.append((i, text, "failed"))
            yield pd.DataFrame(rows, columns=[id_col, "translated", "status"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {kind}, translated string, status string")


@dataclass
class FileMemory:
    """Memory of one file during a sequential run: sources by language, pairs by languages and checksum."""

    sources: dict[str, dict[str, str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str, str], str] = field(default_factory=dict)

    def put(self, src_lang: str, tgt_lang: str, src: str, tgt: str) -> None:
        self.sources.setdefault(src_lang, {})[sha(src)] = src
        self.sources.setdefault(tgt_lang, {})[sha(tgt)] = tgt
        self.pairs[src_lang, tgt_lang, sha(src)] = tgt

    def example(self, src_lang: str, tgt_lang: str, text: str) -> tuple[str, str] | None:
        """The most similar known source above the gate, if it has a translation; the best is chosen first."""
        m = SequenceMatcher()
        m.set_seq2(text)
        best, found = 0.0, None
        for k, s in sorted(self.sources.get(src_lang, {}).items()):
            m.set_seq1(s)
            if m.real_quick_ratio() > best and m.quick_ratio() > best and (r := m.ratio()) > best:
                best, found = r, (k, s)
        if found is None or best <= EXAMPLE_GATE:
            return None
        tgt = self.pairs.get((src_lang, tgt_lang, found[0]))
        return None if tgt is None else (found[1], tgt)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def translate_file(rows: list[dict], memory: FileMemory, ladder: Ladder, terms: str = "") -> list[dict]:
    """Ordered chunks of one file; of repeated chunks the later ones count as new in the run that translated the first.

    The parts of an oversized Typst chunk go through the memory one by one; the chunk is from the memory if all of them are.
    """
    fresh: set[tuple[str, str, str]] = set()

    def one(text: str, kind: str, a: str, b: str) -> tuple[str, bool, str]:
        """Translation of a chunk or part, whether it is from the memory, and its status."""
        key = (a, b, sha(text))
        known = memory.pairs.get(key) if a != b else None
        if known is not None:
            return known, key not in fresh, "cached"
        if passes_through(text, kind, ladder):
            memory.put(a, b, text, text)
            return text, True, "passed"
        parts = parts_of(ladder, text, kind)
        if len(parts) > 1:
            done = [one(p, kind, a, b) if p.strip() else (p, True, "passed") for p in parts]
            t, cached = "".join(d[0] for d in done), all(d[1] for d in done)
        else:
            t, cached = translate_unit(ladder, text, kind, b, terms, memory.example(a, b, text)), False
        if not cached:
            fresh.add(key)
        memory.put(a, b, text, t)
        return t, cached, "cached" if cached else "translated"

    out = []
    for r in rows:
        text = r["content"]
        if text is None or not text.strip():
            out.append(r | {"translated": text, "from_cache": True, "status": "null" if text is None else "passed"})
            continue
        try:
            t, cached, status = one(text, r["kind"], r["src_lang"], r["tgt_lang"])
        except Exception:  # noqa: BLE001
            t, cached, status = text, False, "failed"
        out.append(r | {"translated": t, "from_cache": cached, "status": status})
    return out


def translate_sequential(chunks: DataFrame, memory: DataFrame, ladder: Ladder, terms: str = "") -> DataFrame:
    """``chunk_id, translated, from_cache, status`` with the order of a file; ``chunks`` has an ``ordinal`` besides. NULL paths form one file ''."""
    c = chunks.select("chunk_id", F.coalesce("path", F.lit("")).alias("path"), "src_lang", "tgt_lang", "kind", "content", "ordinal")
    m = memory.select(F.coalesce("path", F.lit("")).alias("path"), "src_lang", "tgt_lang", "content", "translated")
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = FileMemory()
        for r in right.itertuples(index=False):
            known.put(r.src_lang, r.tgt_lang, r.content, r.translated)
        rows = left.sort_values(["tgt_lang", "ordinal"]).astype(object).where(lambda x: x.notna(), None).to_dict("records")
        return pd.DataFrame(translate_file(rows, known, ladder, terms), columns=["chunk_id", "translated", "from_cache", "status"])

    return c.groupBy("path").cogroup(m.groupBy("path")).applyInPandas(run, f"chunk_id {kind}, translated string, from_cache boolean, status string")
