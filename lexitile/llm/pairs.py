"""Defects of prompt and response pairs.

Each pair gets the first defect that applies: 'empty', 'refusal', 'copy', 'other_language', 'truncated'. What shows a
shortened response comes from all responses: they are sorted by text, once within equal prompts and once over all prompts, and compared
with their neighbours' common prefixes; and the lengths of all distinct responses tell where a length limit piles them up. After that
come rules on the pair alone: emptiness, refusal (a classifier over sentences), copy, language, and for what is left breaking off where the
prompt ends a sentence, or having fewer sentences than the prompt.

A response is a shortened one if it is a proper prefix of another response to the same prompt, whatever its label, length or last sign;
or a proper prefix of its neighbour while its prompt is too long for that part of the neighbour's; or if it ends openly at a length where
responses pile up. Trailing blanks and an ellipsis do not count as text.

Defined cases: a prompt without content has no defect; NULL and blank responses are empty; repeated rows count once by
the row key, rows without a key as one; a response equal to its prompt is no shortened one; a copy is no defect where the label names the prompt's own language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexitile.llm.langid import LanguageModel, label_column, sentence_languages
from lexitile.llm.refusals import RefusalModel
from lexitile.llm.texts import blank_markup, blank_sentences, holds_content
from lexitile.sources.tables import ensure_checkpoint_dir, spread

#: Ends of sentences.
CLOSED = set(".!?։…:;)]\"”»’'")
CUT_TAG = re.compile(r"</?[A-Za-z]*\Z")
ELLIPSIS = re.compile(r"(?:\.\.\.|…)\s*\Z")
#: A prefix of a neighbour is a shortened response if this part of its prompt is still longer than its share of the neighbour's; languages differ in length by less.
SHARE = 0.5
#: Lengths pile up where they hold this many times the mean of the lengths around, plus one.
PILE, AROUND = 4.0, 8
DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")


def last_mark(blank: str) -> str:
    """The last sign of a text whose markup is blanked."""
    bare = blank.rstrip()
    return bare[-1] if bare else ""


def overlap(a: list[list[str]], b: list[list[str]]) -> float:
    """Share of a's words found in b."""
    ca, cb = Counter(w.lower() for s in a for w in s), Counter(w.lower() for s in b for w in s)
    return sum((ca & cb).values()) / max(1, sum(ca.values()))


def rule_defects(model: LanguageModel, refusals: RefusalModel, rows: list[tuple[str | None, str | None, str | None, str | None]]) -> Iterator[str | None]:
    """The defect by rules for ``(src_text, tgt_text, src_lang, label)``."""
    blank_s, blank_t = [blank_markup(r[0]) for r in rows], [blank_markup(r[1]) for r in rows]
    src, tgt = [blank_sentences(b) for b in blank_s], [blank_sentences(b) for b in blank_t]
    langs, _ = sentence_languages(model, tgt)
    for (s_text, t_text, s_lang, label), s, t, ls, s_blank, t_blank in zip(rows, src, tgt, langs, blank_s, blank_t):
        names = [model.langs[x] for x in ls]
        if not s_text or not any(c.isalnum() for c in s_text):
            yield None
        elif not t_text or not t_text.strip() or (not holds_content(t_text) and t_text.split() != s_text.split()):
            yield "empty"
        elif refusals.declines(t) and not refusals.declines(s):
            yield "refusal"
        elif s and t and label != s_lang and s_lang in names and sum(len(x) for x, n in zip(t, names) if n == s_lang) >= 0.8 * sum(map(len, t)) and overlap(s, t) >= 0.6:
            yield "copy"
        elif label is not None and t and label not in names and sum(map(len, t)) > 1:
            yield "other_language"
        elif s and (
            len(t) < len(s) or not t or (last_mark(s_blank) in CLOSED and last_mark(t_blank) not in CLOSED)
            or (ELLIPSIS.search(t_text) and not ELLIPSIS.search(s_text)) or (CUT_TAG.search(t_text) and not CUT_TAG.search(s_text))
        ):
            yield "truncated"
        else:
            yield None


def _rules(pairs: DataFrame, model: LanguageModel, refusals: RefusalModel) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast((model, refusals))
    out = T.StructType([T.StructField("id", pairs.schema["id"].dataType), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(rule_defects(*shared.value, list(zip(*(b.column(i).to_pylist() for i in range(1, 5))))))
            keep = [i for i, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([DEFECTS.index(found[i]) for i in keep], pa.int32())], names=out.names)

    return spread(pairs.select("id", "src", "tgt", "src_lang", "label")).mapInArrow(run, out)


def digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def bare(c: Column) -> Column:
    """Without trailing blanks and ellipsis."""
    return F.regexp_replace(c, r"\s*(?:\.\.\.|…)?\s*$", "")


def prefixes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours of ``grp, text, size`` in the order of group and text: ``grp, text_key, bar`` and the number ``c`` of texts of each length ``n``.

    A text that is a proper prefix of its neighbour in the same group comes with ``bar``, the size beyond which it is too short
    for a part of the neighbour. Rows are distinct by group and text and range-partitioned by both, so that an equal group spreads over as many partitions
    as it needs. If a text is a prefix of any later one of its group, it is one of its direct successor; the successor of a partition's
    last text is the first of the next partition that has rows.
    """
    ordered = texts.select("grp", "text", "size").repartitionByRange("grp", "text").sortWithinPartitions("grp", "text")
    fields = [("grp", T.BinaryType(), pa.binary()), ("text", T.StringType(), pa.string()), ("size", T.LongType(), pa.int64()), ("text_key", T.BinaryType(), pa.binary()), ("bar", T.DoubleType(), pa.float64()), ("part", T.IntegerType(), pa.int32()), ("place", T.StringType(), pa.string()), ("n", T.LongType(), pa.int64()), ("c", T.LongType(), pa.int64())]
    out, kinds = T.StructType([T.StructField(n, t) for n, t, _ in fields]), [k for *_, k in fields]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=out.names)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, lengths = TaskContext.get().partitionId(), None, Counter()
        for b in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                lengths[len(row[1])] += 1
                if before is None:
                    rows.append((*row, None, None, part, "first", None, None))
                elif row[0] == before[0] and row[1].startswith(before[1]):
                    rows.append((row[0], None, None, md5(before[1].encode()).digest(), len(before[1]) / len(row[1]) * row[2], part, "prefix", None, None))
                before = row
            yield frame(rows)
        if before is not None:
            yield frame([(*before, None, None, part, "last", None, None), *((None, None, None, None, None, part, "length", n, c) for n, c in lengths.items())])

    found = ordered.mapInArrow(neighbours, out).checkpoint()
    parts = found.where("place = 'first'").select("part")
    follow = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))  # one number a partition
    first = found.where("place = 'first'").select(F.col("part").alias("next"), F.col("grp").alias("g"), F.col("text").alias("longer"), F.col("size").alias("s"))
    edges = found.where("place = 'last'").select("part", "grp", "text").join(follow, "part").join(first, "next").where("grp = g and startswith(longer, text)")
    crossing = edges.select("grp", digest(F.col("text")).alias("text_key"), (F.length("text") / F.length("longer") * F.col("s")).alias("bar"))
    lengths = found.where("place = 'length'").groupBy("n").agg(F.sum("c").alias("c"))
    return found.where("place = 'prefix'").select("grp", "text_key", "bar").unionByName(crossing), lengths


def length_spikes(hist: DataFrame) -> DataFrame:
    """``n``: the lengths at which ``n, c`` piles up against the lengths around."""
    sides = F.array(*[F.col("n") + d for d in range(-AROUND // 2, AROUND // 2 + 1) if d])
    near = hist.select(F.explode(sides).alias("n"), "c").groupBy("n").agg((F.sum("c") / AROUND).alias("around"))
    return hist.join(near, "n", "left").where(F.col("c") >= PILE * (F.coalesce("around", F.lit(0.0)) + 1)).select("n")


def shortened_responses(pairs: DataFrame) -> DataFrame:
    """``id, by`` of the ``id, src, tgt`` pairs whose response is a shortened one by what all responses show: 'prompt', 'neighbour' or 'length'."""
    ensure_checkpoint_dir(pairs.sparkSession)
    p = pairs.where(F.col("src").rlike(r"[\p{L}\p{N}]") & F.col("tgt").rlike(r"[\p{L}\p{N}]")).select("id", digest(F.col("src")).alias("prompt"), F.length("src").cast("bigint").alias("size"), bare(F.col("tgt")).alias("text"), (bare(F.col("src")) == bare(F.col("tgt"))).alias("same"), F.col("src").alias("s"), F.col("tgt").alias("t"))
    by_prompt, _ = prefixes(p.select(F.col("prompt").alias("grp"), "text", F.lit(0).cast("bigint").alias("size")).distinct())
    alone = F.lit(b"")  # one group of all prompts
    by_text, lengths = prefixes(p.groupBy("text").agg(F.max("size").alias("size")).select(alone.alias("grp"), "text", "size"))
    spikes = length_spikes(lengths)
    opens = lambda c: ~F.regexp_replace(c, r"\s+$", "").rlike(r"""[.!?։…:;)\]"”»’'`$}>]$""")
    open_end = opens(F.col("t")) & (~opens(F.col("s")) | (F.col("size") > F.length("text")))
    rows = p.where("not same").select("id", "prompt", "size", digest(F.col("text")).alias("text_key"), F.length("text").cast("bigint").alias("n"), open_end.alias("open_end"))
    rows = rows.join(by_prompt.select(F.col("grp").alias("prompt"), "text_key", F.lit(True).alias("of_prompt")).distinct(), ["prompt", "text_key"], "left")
    rows = rows.join(by_text.select("text_key", "bar"), "text_key", "left").join(spikes.withColumn("spike", F.lit(True)), "n", "left")
    by = F.when(F.col("of_prompt"), "prompt").when(F.col("size") * SHARE > F.col("bar"), "neighbour").when(F.col("spike") & F.col("open_end"), "length")
    return rows.select("id", by.alias("by")).where("by is not null")


def pair_defects(pairs: DataFrame, model: LanguageModel, refusals: RefusalModel, id_col: str, src: str = "src_text", tgt: str = "tgt_text", src_lang: str = "src_lang", label: str = "tgt_lang") -> DataFrame:
    """``id_col, defect`` of each defective pair."""
    p = pairs.select(F.col(id_col).alias("id"), F.col(src).alias("src"), F.col(tgt).alias("tgt"), label_column(F.col(src_lang)).alias("src_lang"), label_column(F.col(label)).alias("label"))
    shortened = shortened_responses(p).select("id", F.lit(DEFECTS.index("truncated")).alias("rank"))
    both = shortened.unionByName(_rules(p, model, refusals)).groupBy("id").agg(F.min("rank").alias("rank"))
    return both.select(F.col("id").alias(id_col), F.element_at(F.array(*map(F.lit, DEFECTS)), F.col("rank") + 1).alias("defect"))
