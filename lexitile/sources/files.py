"""Files as tables: text, notebooks, correspondence and vocabulary CSV, and writing files back.

Defined cases: paths without files give empty tables; notebook sources may be strings or lists of strings; CSV files without
the path column count as legacy rows with the wildcard path; cells that are missing are ''.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitile.functions.keys import document_type

#: Tags of cells that need a look.
REVIEW_TAGS = ("needs_review", "not-translated-due-to-exception")


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``rel_path, length, modified, content, doc_type`` of the files below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index("path", base, -1)
    return files.select(rel.alias("rel_path"), "length", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content")).withColumn("doc_type", document_type(F.col("rel_path"), has_notebook_header(F.col("content"))))


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, length`` of the files below a directory; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("rel_path"), "length")


def has_notebook_header(text: Column) -> Column:
    """A front matter within 30 lines that names a text representation with extension and format."""
    head = F.regexp_extract(text, r"\A---\r?\n((?:(?!---\s*$).*\r?\n){0,29}?)---[ \t]*(?:\r?\n|\z)", 1)
    return F.coalesce(head.rlike(r"(?s)jupytext:.*text_representation:.*extension:") & head.contains("format_name:"), F.lit(False))


def notebook_cells(content: Column) -> Column:
    """``ARRAY<STRUCT<cell_type, source>>`` of a notebook's JSON text; NULL where it is none."""
    cells = F.from_json(F.get_json_object(content, "$.cells"), "array<struct<cell_type:string,source:string>>")
    joined = lambda s: F.coalesce(F.array_join(F.from_json(F.when(s.startswith("["), s), "array<string>"), ""), s)
    return F.transform(cells, lambda c: F.struct(c["cell_type"].alias("cell_type"), joined(c["source"]).alias("source")))


def notebook_checksums(content: Column) -> Column:
    """``ARRAY<STRING>``: the source checksum in the metadata of each cell, NULL for cells without; NULL where it is no notebook."""
    cells = F.from_json(F.get_json_object(content, "$.cells"), "array<struct<metadata:struct<src_checksum:string>>>")
    return F.transform(cells, lambda c: c["metadata"]["src_checksum"])


def notebook_tags(content: Column) -> Column:
    """``ARRAY<ARRAY<STRING>>``: the tags of each cell; NULL where it is no notebook."""
    cells = F.from_json(F.get_json_object(content, "$.cells"), "array<struct<metadata:struct<tags:array<string>>>>")
    return F.transform(cells, lambda c: c["metadata"]["tags"])


def notebook_with(content: Column, sources: Column, flags: Column) -> Column:
    """The notebook with new cell sources and review tags in order; all other keys of notebook, cells and metadata stay.

    ``sources`` and ``flags`` have an entry a cell; a NULL source leaves the cell as it is, an empty flag takes the review tag away.
    """

    @F.pandas_udf("string")
    def run(content: pd.Series, sources: pd.Series, flags: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else fill_notebook(c, list(s), list(f)) for c, s, f in zip(content, sources, flags)])

    return run(content, sources, flags)


def fill_notebook(content: str, sources: list[str | None], flags: list[str]) -> str:
    nb = json.loads(content)
    for cell, source, flag in zip(nb.get("cells", []), sources, flags):
        if source is None:
            continue
        old = "".join(cell["source"]) if isinstance(cell.get("source"), list) else cell.get("source", "")
        meta = cell.setdefault("metadata", {})
        meta["src_checksum"] = hashlib.sha256(old.encode("utf-8")).hexdigest()
        tags = [t for t in meta.get("tags", []) if t not in REVIEW_TAGS] + ([flag] if flag else [])
        meta.pop(REVIEW_TAGS[1], None)
        if flag == REVIEW_TAGS[1]:
            meta[flag] = "True"
        if tags or "tags" in meta:
            meta["tags"] = tags
        cell["source"] = source.splitlines(keepends=True) if isinstance(cell.get("source"), list) else source
    return json.dumps(nb, ensure_ascii=False, indent=1)


def read_correspondence(spark: SparkSession, path: str) -> DataFrame:
    """Wide correspondence CSV with ``row_id`` in the order of the part files' names and of the rows in each; the path column is added if the file lacks it.

    With quoted line ends a file is one split, so the number within a partition keeps the order of its rows.
    """
    df = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    if "path_checksum" not in df.columns:
        df = df.withColumn("path_checksum", F.lit(""))
    df = df.fillna("").withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    files = df.groupBy("file").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    starts = files.select("file", "first", before.alias("before"))
    return df.join(starts, "file").withColumn("row_id", F.col("before") + F.col("at") - F.col("first")).drop("file", "at", "first", "before")


def write_correspondence(wide: DataFrame, path: str) -> None:
    """One CSV directory with a header; missing cells are ''."""
    wide.drop("row_id").fillna("").write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)


def write_files(files: DataFrame, root: str) -> None:
    """Writes ``rel_path, content`` below a directory every executor can reach."""

    def save(rows) -> None:
        from pathlib import Path

        for r in rows:
            p = Path(root) / r["rel_path"]
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(r["content"] or "", encoding="utf-8", newline="")

    files.select("rel_path", "content").foreachPartition(save)


def copy_plan(source: DataFrame, translatable: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Files to copy: those of the source tree that are neither translatable nor at or below an ignored path (``rel_path`` each)."""
    out = source.join(translatable.select("rel_path"), "rel_path", "left_anti")
    if ignored is not None:
        parts = F.split("rel_path", "/")
        up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        below = out.select("rel_path", F.explode(up).alias("above")).join(ignored.select(F.col("rel_path").alias("above")), "above").select("rel_path").distinct()
        out = out.join(below, "rel_path", "left_anti")
    return out


def stale_files(target: DataFrame, source: DataFrame) -> DataFrame:
    """Files of the target tree that the source tree lacks."""
    return target.join(source.select("rel_path"), "rel_path", "left_anti")
