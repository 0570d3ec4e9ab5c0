"""Text garbled by a wrong character encoding: finding and restoring it.

Every distinct word of the corpus that has signs beyond ASCII is garbled under all chains of encodings (written in one, read in
another, once or twice, with and without loss), and all words of the documents are joined with these forms by equality. No word is left
out because of its looks. A word is taken for a garbled form by its frequency against its original's; what a chain proves by itself
(a form that is valid UTF-8, signs lost, signs no language has) adds to that. The evidence of a document for a chain is the sum over its words,
but no more than the signs and letters it rests on can carry, so that single signs, which may be signs of their own, prove
nothing alone. They count where most documents that hold them are garbled by that chain, known from their other words.

A restored document has its garbled words substituted. Words without a known original, and short words that may be either, follow the
words beside them and are turned back by the chains of the document; ``n_left`` counts those that can't be.

Defined cases: NULL, empty and ASCII texts are clean; words in code spans (single backquotes) are quotations and never count;
repeated rows give one result row a document id; signs lost to U+FFFD or '?' are restored by the most frequent corpus word that fits;
where a form is as frequent as its original and looks no stranger, nothing is garbled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexitile.sources.tables import ensure_checkpoint_dir, spread

#: Encodings a text is written in, and single-byte encodings it is read in by mistake.
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-u", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "mac_roman", "mac_cyrillic")
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-u", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "mac_roman", "iso8859-2", "iso8859-15", "mac_cyrillic")
#: Encodings with bytes that mean nothing, which a reader may drop or replace.
PARTIAL = ("cp1252", "cp1250", "cp1251")
#: Readings that follow each other in doubly garbled texts.
TWICE = tuple((a, b) for a in ("cp1252", "latin-1", "cp1251", "cp1250") for b in ("cp1252", "latin-1", "cp1251", "cp1250"))

#: Signs of clean words in the six languages.
LATIN = "A-Za-zäöüßÄÖÜàâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸáíóúñÁÍÓÚÑﬀ-ﬆ"
CYRILLIC = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюяАБВГҐДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЬЮЯ"
ARMENIAN = "Ա-Ֆա-և"
GREEK = "Α-ω"
SYMBOLS = "«»§°±×¿¡“”„‚‹›•…‰€№≤≥≈≠∞∑∫√∂"
SIGNS = SYMBOLS + "\u0300-\u036f\u0559-\u055f\u00a0\u00adµ·\u2000-\u2019\u201b\u201f\u2026-\u202f′″\u2060→←↔⇒∈։֊\ufeff−ʼ"
STRANGE = f"[^\\x00-\\x7f{LATIN}{CYRILLIC}{ARMENIAN}{GREEK}{SIGNS}]"
_LETTER = f"[{LATIN}{CYRILLIC}{ARMENIAN}]"
#: Clean signs in orders that no language has: scripts within a word mixed, a symbol between letters, a capital with accent or 'â'
#: before a symbol, small before capital Cyrillic.
TELLTALE = "|".join([
    f"[{LATIN}][{CYRILLIC}{ARMENIAN}]", f"[{CYRILLIC}{ARMENIAN}{GREEK}][À-ÿŒœŸ]", f"[{CYRILLIC}][{LATIN}{ARMENIAN}]", f"[{ARMENIAN}][{LATIN}{CYRILLIC}]",
    f"{_LETTER}[{SYMBOLS}]{_LETTER}", f"[À-ÖØ-Þ][{SYMBOLS}µ·\u00a0\u2010-\u2015‘]", "â€", "[а-яґєії][А-ЯҐЄІЇ]",
])
_ODD = re.compile(f"{STRANGE}|{TELLTALE}")
#: Words consist of letters, digits, '?' (it may stand for a lost sign) and anything beyond ASCII.
PARTS = r"[0-9A-Za-z?\x80-\U0010ffff]+"
LOST = r"[A-Za-z]\?[A-Za-z]"
SPAN = r"`[^`\n]*`"


#: Evidence a document needs for a chain, as a logarithm; what one changed sign can carry at most, and half as many again for each ASCII letter beside it;
#: what a word must gain to count as evidence; what a form proves by itself: by each sign of a valid UTF-8 sequence, by a lost sign, by signs or orders of signs that no language has.
EVIDENCE, SIGN, LEAST, VALID, LOST_SIGN, ODD = 4.0, 2.0, 2.0, 1.4, 4.0, 2.0


def is_odd(word: str) -> bool:
    return bool(_ODD.search(word))


@lru_cache(maxsize=None)
def _tables(name: str) -> tuple[list[str], dict[str, int]]:
    """Sign of each byte and byte of each sign; bytes without a sign keep their number."""
    signs = []
    for b in range(256):
        try:
            signs.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            signs.append(chr(b))
    return signs, {s: b for b, s in reversed(list(enumerate(signs)))}


def write(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        return text.encode("utf-8")
    table = _tables(name)[1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def read(data: bytes, name: str) -> str:
    signs = _tables(name)[0]
    return "".join([signs[b] for b in data])


def turn_back(word: str, chain: str) -> str | None:
    """The original of a word garbled by a chain without loss, None if it isn't such a word."""
    steps = chain.split(">")
    if steps[-1] == "lost":
        return None
    data: bytes | None = b""
    for n, name in enumerate(reversed(steps[1:])):
        data = write(word, name)
        if data is None:
            return None
        if n < len(steps) - 2:
            try:
                word = data.decode("utf-8")
            except UnicodeDecodeError:
                return None
    try:
        return data.decode("utf-8") if steps[0] == "utf-8" else read(data, steps[0])
    except UnicodeDecodeError:
        return None


def garbled_forms(word: str) -> Iterator[tuple[str, str]]:
    """``(form, chain)`` of a word: a chain is 'written>read', 'utf-8>read>read' or '…>lost'. Several chains may give one form."""
    seen = {word}
    raw = word.encode("utf-8")
    for name in WRITTEN:
        data = raw if name == "utf-8" else write(word, name)
        if data is None:
            continue
        for r in READ:
            form = read(data, r)
            if form != word:
                yield form, f"{name}>{r}"
            if r in PARTIAL:
                seen.add(form)
                for how in ("ignore", "replace"):
                    form = data.decode(r, how)
                    if form not in seen:
                        seen.add(form)
                        yield form, f"{name}>{r}>lost"
        if name != "utf-8":
            form = data.decode("utf-8", "replace")
            if form not in seen and "�" in form:
                seen.add(form)
                yield form, f"{name}>lost"
    for a, b in TWICE:
        yield read(read(raw, a).encode("utf-8"), b), f"utf-8>{a}>{b}"
    for form in (raw.decode("ascii", "replace"), "".join(c if c < "\x80" else "�" for c in word), word.encode("ascii", "replace").decode()):
        if form not in seen and ("�" in form or re.search(LOST, form)):
            seen.add(form)
            yield form, "utf-8>lost"


def scan_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, words``: the distinct words beyond ASCII or with an inner '?' of each document that has any, and the runs beyond ASCII within them.

    The runs find garbled words whose original stands nowhere else; code spans are left out.
    """
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("words", T.ArrayType(T.StringType()))])
    word, span, lost, run = re.compile(PARTS), re.compile(SPAN), re.compile(LOST), re.compile(r"[^\x00-\x7f]+")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if not text or (text.isascii() and "?" not in text):
                    continue
                found = {w for w in set(word.findall(span.sub(" ", text) if "`" in text else text)) if not w.isascii() or lost.search(w)}
                found.update(r for w in [*found] for r in run.findall(w))
                if found:
                    at.append(i)
                    words.append(list(found))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.list_(pa.string()))], names=out.names)

    return spread(docs.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())).mapInArrow(scan, out)


def changed_signs(form: str, original: str, chain: str) -> str:
    """The distinct signs of a form that differ from the original's: by position for single bytes, all beyond ASCII else."""
    if len(form) == len(original) and not chain.endswith("lost"):
        return "".join(sorted({a for a, b in zip(form, original) if a != b}))
    return "".join(sorted({c for c in form if c > "\x7f" or c == "?"}))


def proof(form: str, original: str, chain: str) -> float:
    """What a form proves by itself, as a logarithm."""
    valid = sum(c > "\x7f" for c in form) if chain.startswith("utf-8") and not chain.endswith("lost") else 0
    return ODD * (is_odd(form) - is_odd(original)) + (LOST_SIGN if "�" in form else VALID * valid)


def garbled_words(counts: DataFrame) -> DataFrame:
    """``word, chain, original, m, gain, signs, letters``: words of ``word, n`` that are forms of another, for each chain the likeliest original.

    ``m`` is the original's frequency; ``gain`` is the logarithm of how much more frequent the original is, and of what the form proves by itself.
    """
    forms = T.StructType([T.StructField(c, T.StringType()) for c in ("word", "original", "chain")] + [T.StructField("m", T.LongType())])
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())

    def garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                rows = [(form, w, chain, m) for w, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for form, chain in garbled_forms(w)]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=forms.names)

    @F.pandas_udf("signs string, proof double")
    def shown(word: pd.Series, original: pd.Series, chain: pd.Series) -> pd.DataFrame:
        rows = list(zip(word, original, chain))
        return pd.DataFrame({"signs": [changed_signs(*r) for r in rows], "proof": [proof(*r) for r in rows]})

    hits = counts.mapInArrow(garble, forms).join(counts, "word").withColumn("shown", shown("word", "original", "chain"))
    gain = F.log(F.col("m") / F.col("n")) + F.col("shown.proof")
    best = hits.withColumn("gain", gain).where("gain > 0").groupBy("word", "chain").agg(F.max(F.struct("gain", "m", "original", "shown.signs")).alias("b"))
    letters = F.length(F.regexp_replace("word", "[^A-Za-z]", ""))
    return best.select("word", "chain", "b.original", "b.m", "b.gain", "b.signs", letters.alias("letters"))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned documents, the words that may be garbled, and ``id, chain, e`` of each garbled document: the chains it is garbled by and their evidence."""
    ensure_checkpoint_dir(docs.sparkSession)
    cores = docs.sparkSession.sparkContext.defaultParallelism  # few words still are many forms
    scanned = scan_words(docs, id_col, text_col).dropDuplicates(["id"]).checkpoint()  # words of documents that have any beyond ASCII, read twice
    words = scanned.select("id", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).repartition(cores, "word").checkpoint()  # one row a distinct word, read twice
    forms = garbled_words(counts).checkpoint()  # words that may be garbled, read once or twice
    hits = words.join(forms.where(F.col("gain") >= LEAST), "word").select("id", "word", "chain", "gain", "signs", "letters").checkpoint()  # a row for each word that counts as evidence, read twice
    # The signs of one document: bounded by its distinct garbled words.
    signs = F.array_distinct(F.split(F.concat_ws("", F.collect_set("signs")), ""))
    carried = SIGN * F.size(F.array_remove(signs, "")) + F.sum("letters") / 2 + F.when(F.array_contains(signs, "�"), LOST_SIGN).otherwise(0.0)
    sure = hits.groupBy("id", "chain").agg(F.sum("gain").alias("e"), carried.alias("carried")).where(F.least("e", "carried") >= EVIDENCE).select("id", "chain", "e")
    # A sign that may be a sign of its own: garbled where more documents with it are known to be, by the same chain, than are not known to be by any.
    known = hits.join(sure, ["id", "chain"], "left").join(sure.select("id", F.lit(True).alias("any")).distinct(), "id", "left")
    rest = known.groupBy("word", "chain").agg(F.count("e").alias("by_chain"), F.count_if(F.col("any").isNull()).alias("open")).where("by_chain > open").select("word", "chain")
    more = hits.join(rest, ["word", "chain"], "left_semi").select("id", "chain", F.lit(0.0).alias("e"))
    return scanned, forms, sure.unionByName(more).groupBy("id", "chain").agg(F.max("e").alias("e"))


def garbled_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, chain, e`` of each document with garbled words."""
    return _judged(docs, id_col, text_col)[2]


def find_garbled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, word, original, chain``: the garbled words of each document under the chains it is garbled by."""
    return _explained(*_judged(docs, id_col, text_col)).select("id", "word", "original", "chain")


def _explained(scanned: DataFrame, forms: DataFrame, garbled: DataFrame) -> DataFrame:
    """``id, word, original, chain, m, e``: every word of a garbled document that one of its chains explains."""
    words = scanned.join(garbled.select("id").distinct(), "id", "left_semi").select("id", F.explode("words").alias("word"))
    return words.join(forms, "word").join(garbled, ["id", "chain"]).select("id", "word", "original", "chain", "m", "e")


def restore_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, text, n_restored, n_left`` of each affected document: the restored text, words substituted and garbled words left."""
    judged = _judged(docs, id_col, text_col)
    scanned, found = judged[0], _explained(*judged)
    found = found.checkpoint()  # garbled words of the affected documents, read three times
    ids = found.select("id").distinct()
    lossless = ~F.col("chain").endswith("lost")
    best = found.groupBy("id", "word").agg(F.max(F.struct(lossless.alias("l"), "e", "m", "original"))["original"].alias("original"), F.collect_set(F.struct(-F.col("e"), "chain")).alias("chains"))
    # The distinct garbled words and chains of one document: bounded by the document.
    maps = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "original"))).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chains"))))["chain"].alias("chains"))
    # Words of affected documents that clean documents hold as well.
    clean = scanned.join(ids, "id", "left_anti").select(F.explode("words").alias("word")).distinct()
    own = scanned.join(ids, "id", "left_semi").select("id", F.explode("words").alias("word")).join(clean, "word", "left_semi").groupBy("id").agg(F.collect_set("word").alias("clean"))
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_restored", T.LongType()), T.StructField("n_left", T.LongType())])

    def substitute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [restore_text(text, dict(words), chains, set(clean or ())) for text, words, chains, clean in zip(*(b.column(i).to_pylist() for i in range(1, 5)))]
            texts, done, left = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(done, pa.int64()), pa.array(left, pa.int64())], names=out.names)

    affected = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(maps, "id").dropDuplicates(["id"]).join(own, "id", "left")
    return affected.select("id", "text", "words", "chains", "clean").mapInArrow(substitute, out)


TOKEN = re.compile(f"({SPAN})|({PARTS})")


def restore_text(text: str, words: dict[str, str], chains: list[str], clean: set[str]) -> tuple[str, int, int]:
    """The restored text, the number of words substituted and of garbled words left.

    ``words`` has the originals of garbled words, ``clean`` the words that clean documents hold too, ``chains`` begins with the likeliest. Words of three signs and more beyond ASCII
    decide for themselves; the others, and those in neither, follow the nearest words that do.
    """
    ways = [c for c in chains if not c.endswith("lost")]
    tokens = [m for m in TOKEN.finditer(text) if m.group(2) and (not m.group(2).isascii() or m.group(2) in words)]
    state: list[bool | None] = []  # garbled, clean, to be told by its neighbours
    for m in tokens:
        w = m.group(2)
        short = sum(c > "\x7f" for c in w) < 3
        if w in words:
            state.append(None if short and w in clean else True)
        elif is_odd(w):
            state.append(True)
        else:
            state.append(False if w in clean and not short else None)
    before, after, last = [], [], None
    for s in state:
        before.append(last)
        last = s if s is not None else last
    last = None
    for s in reversed(state):
        after.append(last)
        last = s if s is not None else last
    after.reverse()
    out, at, done, left = [], 0, 0, 0
    for m, s, lo, hi in zip(tokens, state, before, after):
        w, o = m.group(2), None
        sides = [x for x in (lo, hi) if x is not None]
        if s is None:
            s = bool(sides) and (all(sides) if w in clean else any(sides))
        if s:
            back = (x for x in (turn_back(w, c) for c in ways) if x is not None and x != w and not is_odd(x))
            o = words.get(w) or next(back, None)
            if o is None and (is_odd(w) or w not in clean):
                left += 1
        if o is not None:
            out += [text[at : m.start()], o]
            at, done = m.end(), done + 1
    return "".join([*out, text[at:]]), done, left
