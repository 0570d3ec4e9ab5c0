"""Chunking and segmentation of documents, packing of ordered pieces, long-text splitting.

Defined cases: NULL texts have no chunks and no segments, '' has none either; very long texts are scanned whole; repeated
rows give repeated results (every result row carries the id it came with).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexitile.functions.markup import checked, chunk, segment
from lexitile.functions.packing import packed
from lexitile.functions.units import build, placeholder_only, reconstruct

SEGMENT = "array<struct<kind:string,content:string>>"
UNIT = "struct<xml:string,placeholders:map<string,string>,ph_only:boolean>"


def segments_of(text: Column, kind: Column, **options) -> Column:
    @F.pandas_udf(SEGMENT)
    def run(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [{"kind": x, "content": y} for x, y in segment(a, b, **options)] for a, b in zip(t, k)])

    return run(text, kind)


def units_of(text: Column, kind: Column) -> Column:
    """XML unit, placeholders and whether nothing is to be translated; blank text counts as nothing for Typst only."""

    @F.pandas_udf(UNIT)
    def run(t: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(t, k):
            s = segment(a, b)
            xml, held = build(s)
            rows.append((xml, held, b in ("python", "java", "rust", "code") or placeholder_only(s, b == "typst")))
        return pd.DataFrame(rows, columns=["xml", "placeholders", "ph_only"])

    return run(text, kind)


def reconstructed(unit: Column) -> Column:
    """The text of a unit; NULL where its XML is not well formed."""

    @F.pandas_udf("string")
    def run(xml: pd.Series, held: pd.Series) -> pd.Series:
        from xml.etree.ElementTree import ParseError

        out = []
        for x, h in zip(xml, held):
            try:
                out.append(None if x is None else reconstruct(x, dict(h or {})))
            except ParseError:
                out.append(None)
        return pd.Series(out)

    return run(unit["xml"], unit["placeholders"])


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, type_col: str) -> DataFrame:
    """``id_col, ordinal, kind, content`` of each document; only LaTeX, MyST (markdown) and Typst documents have chunks."""
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ordinal", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, c["kind"], c["content"]) for i, t, k in zip(b["id"], b["text"], b["kind"]) for n, c in enumerate(chunk(t, k))]
            yield pd.DataFrame(rows, columns=out.names)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(type_col).alias("kind"))
    return src.where(F.col("kind").isin("latex", "markdown", "myst", "typst") & F.col("text").isNotNull()).mapInPandas(run, out)


def line_blocks(text: Column, n: int) -> Column:
    """Array of blocks of n lines, line ends kept; the whole text for n < 1."""
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))
    if n < 1:
        return F.array(text)
    starts = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)), F.lit(n))
    return F.transform(starts, lambda s: F.array_join(F.slice(lines, s, n), ""))


def with_sections(pieces: DataFrame, file: list[str], ordinal: str, is_heading: Column) -> DataFrame:
    """Adds ``section``: the running count of headings in a file."""
    w = Window.partitionBy(*file).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("section", F.sum(is_heading.cast("int")).over(w))


def section_chunks(pieces: DataFrame, file: list[str], ordinal: str, limit: int) -> DataFrame:
    """Groups of pieces: a section within the limit is one group, pieces of a longer one stand alone. Adds ``group_start``."""
    w = Window.partitionBy(*file, "section")
    return pieces.withColumn("group_start", F.when(F.sum(F.length("content")).over(w) > limit, F.col(ordinal)).otherwise(F.min(ordinal).over(w)))


def greedy_pack(lengths: Column, limit: int) -> Column:
    """Sizes of the packs of ordered lengths: a new pack starts where the limit would be passed; a longer one stands alone. Linear in the lengths."""

    @F.pandas_udf("array<bigint>")
    def run(sizes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else packs([int(n) for n in x], limit) for x in sizes])

    return run(lengths)


def packs(sizes: list[int], limit: int) -> list[int]:
    return [n for n in (sum(sizes[x]) for x in packed(sizes, limit)) if n]


def split_long(text: Column, limit: int) -> Column:
    """Pieces cut after the last white space at or before index ``limit``, or hard at the limit if that cut lies below 0.6 of it.

    A piece may have limit + 1 characters; the pieces join to the text.
    """

    @F.pandas_udf("array<string>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else long_pieces(x, limit) for x in t])

    return run(text)


def long_pieces(text: str, limit: int) -> list[str]:
    out, at, floor = [], 0, int(0.6 * limit)
    while len(text) - at > limit:
        cut = next((k + 1 for k in range(limit, -1, -1) if text[at + k].isspace()), 0)
        cut = cut if cut >= max(1, floor) else limit
        out.append(text[at : at + cut])
        at += cut
    return [*out, text[at:]] if text[at:] or not out else out


def coalesced(segments: Column) -> Column:
    """Neighbouring placeholders merged, a bare line end stays alone, neighbouring texts joined.

    The places where a run begins are marked first and each run is joined once, so the work is linear in the segments.
    """
    typed = F.transform(F.filter(segments, lambda s: s["content"] != ""), lambda s: F.struct(F.when(s["kind"] == "text", "text").otherwise("placeholder").alias("kind"), s["content"].alias("content")))

    def runs(t: Column) -> Column:
        def begins(i: Column) -> Column:
            here, last = F.get(t, i), F.get(t, i - 1)
            bare = (here["kind"] == "placeholder") & ((here["content"] == "\n") | (last["content"] == "\n"))
            return (i == 0) | (here["kind"] != last["kind"]) | bare

        n = F.size(t)
        starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), begins)
        each = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n)).alias("z"))  # each start with the next one
        return F.transform(F.slice(each, 1, F.size(starts)), lambda r: F.struct(F.get(t, r["a"])["kind"].alias("kind"), F.array_join(F.transform(F.slice(t, r["a"] + 1, r["z"] - r["a"]), lambda s: s["content"]), "").alias("content")))

    # A one-element array evaluates the inner expression once.
    return F.flatten(F.transform(F.array(typed), runs))


def built(segments: Column) -> Column:
    """The XML unit of segments with its placeholders, whether there is no text, and whether none but white space."""

    @F.pandas_udf("struct<xml:string,placeholders:map<string,string>,ph_only:boolean,ph_only_blank:boolean>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            pairs = [(y["kind"], y["content"]) for y in x]
            xml, held = build(pairs)
            rows.append((xml, held, placeholder_only(pairs), placeholder_only(pairs, True)))
        return pd.DataFrame(rows, columns=["xml", "placeholders", "ph_only", "ph_only_blank"])

    return run(segments)


def given_back(text: Column, kind: Column) -> Column:
    """Whether the scanner of a kind gives the text back whole; where not, the text is one placeholder."""

    @F.pandas_udf("boolean")
    def run(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([checked(a, b)[1] for a, b in zip(t, k)])

    return run(text, kind)
