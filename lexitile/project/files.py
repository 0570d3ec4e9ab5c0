"""Translating, synchronising and correcting the files of a project with Spark.

The memory of a project is a Parquet table ``path, src_lang, tgt_lang, content, translated, seq`` in its folder, written as a new snapshot each
run; of equal keys the last ``seq`` counts. A file names the snapshot that holds and is replaced in one step, so a run that ends early leaves the
old one in place.

A notebook in text form keeps its front matter; its body is chunked like other MyST.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitile.functions.keys import content_checksum
from lexitile.functions.text import compile_cells, parse_metadata, py_strip, split_cells
from lexitile.operators.chunking import chunk_documents
from lexitile.operators.memory import review_flags
from lexitile.operators.translation import Ladder, translate_plain, translate_sequential
from lexitile.project import FOLDER, Project, ProjectError
from lexitile.sources.files import REVIEW_TAGS, notebook_cells, notebook_checksums, notebook_tags, notebook_with, text_files, write_files

MEMORY = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "src_lang", "tgt_lang", "content", "translated")] + [T.StructField("seq", T.LongType())])
KIND = {"latex": "latex", "markdown": "myst", "typst": "typst"}


def memory_path(p: Project) -> Path:
    """Folder of the snapshot that holds."""
    pointer = p.root / FOLDER / "memory.current"
    return p.root / FOLDER / (pointer.read_text(encoding="utf-8").strip() if pointer.exists() else "memory")


def memory(spark: SparkSession, p: Project) -> DataFrame:
    path = memory_path(p)
    return spark.read.schema(MEMORY).parquet(str(path)) if path.exists() else spark.createDataFrame([], MEMORY)


def _replace_memory(p: Project, rows: DataFrame) -> None:
    """Writes a snapshot, points to it in one step and removes the one before."""
    old, name = memory_path(p), f"memory-{uuid.uuid4().hex}"
    rows.write.parquet(str(p.root / FOLDER / name))
    pointer = p.root / FOLDER / "memory.next"
    pointer.write_text(name, encoding="utf-8")
    os.replace(pointer, p.root / FOLDER / "memory.current")
    if old.exists():
        shutil.rmtree(old)


def save_memory(spark: SparkSession, p: Project, new: DataFrame) -> None:
    """Adds rows to the memory; they come after those it has."""
    key = ["path", "src_lang", "tgt_lang", "content"]
    old = memory(spark, p)
    base = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    rows = old.unionByName(new.withColumn("seq", F.col("seq") + base + 1).select(*MEMORY.names))
    _replace_memory(p, rows.groupBy(*key).agg(F.max(F.struct("seq", "translated")).alias("m")).select(*key, "m.translated", "m.seq"))


def project_files(spark: SparkSession, root: Path) -> DataFrame:
    """``rel_path, content, doc_type, head`` of the files below a directory; a notebook in text form is MyST with its front matter as ``head``."""
    front = F.regexp_extract("content", r"(?s)\A(---[ \t]*\r?\n.*?\n---[ \t]*(?:\r?\n|\z))", 1)
    textual = (F.col("doc_type") == "jupyter") & (front != "")
    files = text_files(spark, str(root)).withColumn("head", F.when(textual, front).otherwise(""))
    return files.select("rel_path", F.when(textual, F.substr("content", F.length("head") + 1)).otherwise(F.col("content")).alias("content"), F.when(textual, "markdown").otherwise(F.col("doc_type")).alias("doc_type"), "head")


def sources(spark: SparkSession, p: Project, only: str | None = None) -> DataFrame:
    """``rel_path, content, doc_type, head`` of the translatable files, paths below the source directory."""
    if not p.config.source or not p.config.translatable:
        raise ProjectError("nothing to translate")
    base = p.config.source["path"]
    names = [Path(x).relative_to(base).as_posix() for x in p.config.translatable]
    if only is not None and only not in names:
        raise ProjectError(f"{only} is not translatable")
    return project_files(spark, p.root / base).where(F.col("rel_path").isin([only] if only else names))


def _cells(files: DataFrame) -> DataFrame:
    """``rel_path, ordinal, kind, content, type`` of all chunked files: notebooks by their cells, others by their chunker."""
    kinds = F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])
    chunked = chunk_documents(files.select("rel_path", "content", kinds[F.col("doc_type")].alias("kind")), "rel_path", "content", "kind").drop("kind")
    plain = chunked.join(files.select("rel_path", kinds[F.col("doc_type")].alias("type")), "rel_path").select("rel_path", "ordinal", F.col("type").alias("kind"), "content", "type")
    books = files.where("doc_type = 'jupyter'").select("rel_path", F.posexplode(notebook_cells(F.col("content"))).alias("ordinal", "c"))
    kind = F.when(F.col("c.cell_type") == "markdown", "myst").otherwise("code")
    return plain.unionByName(books.select("rel_path", "ordinal", kind.alias("kind"), F.col("c.source").alias("content"), F.lit("jupyter").alias("type")))


def translate(spark: SparkSession, p: Project, lang: str, ladder: Ladder, terms: str = "", only: str | None = None) -> DataFrame:
    """Translates files into a language and writes them with the metadata of each chunk; ``rel_path, status, n`` counts.

    A new translation is marked for review, also where it repeats a chunk of the same run; one from the memory keeps the mark it has in the target file.
    """
    out, src = p.target(lang), p.config.source["lang"]
    ladder.typst_args = ladder.typst_args or p.config.typst_args
    files = sources(spark, p, only)
    c = _cells(files).select(F.col("rel_path").alias("path"), "ordinal", "content", "kind", "type", F.lit(src).alias("src_lang"), F.lit(lang).alias("tgt_lang"))
    c = c.withColumn("chunk_id", F.concat_ws("\x1f", "path", "ordinal"))
    answers = translate_sequential(c, memory(spark, p).drop("seq"), ladder, terms).persist()  # each request is asked once
    done = answers.join(c.select("chunk_id", "path", "ordinal", "content", "type", "src_lang", "tgt_lang"), "chunk_id")
    done = done.withColumn("src_checksum", content_checksum(F.col("content")))
    flags = review_flags(done.select(F.col("chunk_id").alias("cell_id"), "path", "src_checksum", "ordinal", F.col("from_cache").alias("hit"), (F.col("status") == "failed").alias("failed")), target_cells(spark, out).select("path", "src_checksum", "ordinal", "needs_review"))
    done = done.join(flags.withColumnRenamed("cell_id", "chunk_id"), "chunk_id").persist()
    marks = F.map_from_arrays(F.array(*map(F.lit, ("src_checksum", *REVIEW_TAGS))), F.array("src_checksum", *[F.when(F.col("flag") == t, "True") for t in REVIEW_TAGS]))
    meta = F.map_filter(marks, lambda k, v: v.isNotNull())
    whole = done.groupBy("path", "type").agg(F.array_sort(F.collect_list(F.struct("ordinal", meta.alias("meta"), F.col("translated").alias("source"), "flag")), lambda a, b: a["ordinal"] - b["ordinal"]).alias("cells"))
    whole = whole.join(files.select(F.col("rel_path").alias("path"), "content", "head"), "path").persist()
    text = F.when(F.col("type") == "latex", compile_cells("latex", F.col("cells"))).when(F.col("type") == "myst", compile_cells("myst", F.col("cells"))).otherwise(compile_cells("typst", F.col("cells")))
    write_files(whole.where("type != 'jupyter'").select(F.col("path").alias("rel_path"), F.concat("head", text).alias("content")), str(out))
    write_files(whole.where("type = 'jupyter'").select(F.col("path").alias("rel_path"), notebook_with(F.col("content"), F.col("cells.source"), F.col("cells.flag")).alias("content")), str(out))
    other = translate_plain(files.where("doc_type = 'other'"), "rel_path", "content", ladder, src, lang, terms).persist()
    write_files(other.where("status = 'translated'").select("rel_path", F.col("translated").alias("content")), str(out))
    counts = done.groupBy(F.col("path").alias("rel_path"), "status").count().unionByName(other.groupBy("rel_path", "status").count())
    rows = [tuple(r) for r in counts.collect()]  # one row a file and status
    save_memory(spark, p, done.where("status in ('translated', 'passed') and content is not null").select("path", "src_lang", "tgt_lang", "content", "translated", F.col("ordinal").cast("bigint").alias("seq")))
    for x in (answers, done, whole, other):
        x.unpersist()
    return spark.createDataFrame(rows, "rel_path string, status string, n bigint")


def target_cells(spark: SparkSession, root: Path) -> DataFrame:
    """``path, ordinal, src_checksum, translated, needs_review`` of the cells in a target directory that carry a source checksum."""
    targets = project_files(spark, root)
    out = None
    for doc_type, kind in KIND.items():
        t = targets.where(F.col("doc_type") == doc_type).select("rel_path", F.posexplode(split_cells(kind, F.col("content"))).alias("ordinal", "cell"))
        meta = parse_metadata(kind, F.col("cell.block"))
        t = t.select(F.col("rel_path").alias("path"), "ordinal", meta["src_checksum"].alias("src_checksum"), F.col("cell.source").alias("translated"), F.coalesce(meta[REVIEW_TAGS[0]] == "True", F.lit(False)).alias("needs_review"))
        out = t if out is None else out.unionByName(t)
    both = F.arrays_zip(notebook_cells(F.col("content")).alias("cell"), notebook_checksums(F.col("content")).alias("sum"), notebook_tags(F.col("content")).alias("tags"))
    books = targets.where("doc_type = 'jupyter'").select("rel_path", F.posexplode(both).alias("ordinal", "c"))
    out = out.unionByName(books.select(F.col("rel_path").alias("path"), "ordinal", F.col("c.sum").alias("src_checksum"), F.col("c.cell.source").alias("translated"), F.coalesce(F.array_contains("c.tags", REVIEW_TAGS[0]), F.lit(False)).alias("needs_review")))
    return out.where("src_checksum is not null")


def recovered(spark: SparkSession, p: Project, lang: str) -> DataFrame:
    """``path, content, translated, ordinal``: target cells joined with the first source chunk of their checksum."""
    cells = _cells(sources(spark, p))
    first = cells.groupBy(F.col("rel_path").alias("path"), content_checksum(F.col("content")).alias("src_checksum")).agg(F.min(F.struct("ordinal", "content"))["content"].alias("content"))
    return target_cells(spark, p.target(lang)).join(first, ["path", "src_checksum"]).select("path", "content", "translated", "ordinal")


def correct(spark: SparkSession, p: Project, lang: str, only: str | None = None) -> DataFrame:
    """Takes what was corrected by hand in the target files of a language over into the memory: ``rel_path, corrected``.

    A cell is corrected if the memory has another translation of its source chunk; of a source repeated in a file the last target counts. Files without
    a corrected cell are listed with 0.
    """
    if not p.config.source:
        raise ProjectError("no source language")
    src = p.config.source["lang"]
    found = recovered(spark, p, lang)
    found = found if only is None else found.where(F.col("path") == only)
    last = found.groupBy("path", "content").agg(F.max(F.struct("ordinal", "translated")).alias("m")).select("path", "content", "m.ordinal", "m.translated")
    known = memory(spark, p).where((F.col("src_lang") == src) & (F.col("tgt_lang") == lang)).select("path", "content", py_strip(F.col("translated")).alias("known"))
    c = last.join(known, ["path", "content"]).withColumn("differs", ~py_strip(F.col("translated")).eqNullSafe(F.col("known"))).persist()
    rows = [tuple(r) for r in c.groupBy("path").agg(F.count_if("differs")).collect()]  # one row a file
    if any(n for _, n in rows):
        save_memory(spark, p, c.where("differs").select("path", F.lit(src).alias("src_lang"), F.lit(lang).alias("tgt_lang"), "content", "translated", F.col("ordinal").cast("bigint").alias("seq")))
    c.unpersist()
    return spark.createDataFrame(rows, "rel_path string, corrected bigint")


def sync(spark: SparkSession, p: Project, langs: list[str] | None = None) -> dict[str, int]:
    """Rebuilds the memory from the files; pairs by language. Of a source repeated in a file the last target counts."""
    if not p.config.targets:
        raise ProjectError("no target languages")
    out = {}
    for lang in langs or [t["lang"] for t in p.config.targets]:
        pairs = recovered(spark, p, lang)
        out[lang] = pairs.count()
        save_memory(spark, p, pairs.select("path", F.lit(p.config.source["lang"]).alias("src_lang"), F.lit(lang).alias("tgt_lang"), "content", "translated", F.col("ordinal").cast("bigint").alias("seq")))
    return out


def _keep(spark: SparkSession, p: Project, kept: Column) -> int:
    """Leaves the rows of the memory for which ``kept`` holds; the number removed."""
    m = memory(spark, p).persist()
    n = m.where(~kept).count()
    if n:
        _replace_memory(p, m.where(kept))
    m.unpersist()
    return n


def clear_missing(spark: SparkSession, p: Project) -> int:
    """Removes rows of the memory whose source or target chunk is missing; the number removed.

    A row holds both of its chunks, so no chunk is left without a row. A row has no source if it is not from the project's source language.
    """
    if not p.config.source:
        raise ProjectError("no source language")
    return _keep(spark, p, F.col("content").isNotNull() & F.col("translated").isNotNull() & F.col("src_lang").eqNullSafe(F.lit(p.config.source["lang"])))


def clear(spark: SparkSession, p: Project, lang: str | None = None, path: str | None = None, keyword: str | None = None) -> int:
    """Removes rows of the memory by language, file and literal keyword; the number removed."""
    scope = F.lit(True)
    for c, v in (("tgt_lang", lang), ("path", path)):
        if v is not None:
            scope &= F.col(c) == v
    if keyword is not None:
        scope &= F.coalesce(F.col("content").contains(keyword), F.lit(False)) | F.coalesce(F.col("translated").contains(keyword), F.lit(False))
    return _keep(spark, p, ~F.coalesce(scope, F.lit(False)))


def model_of(call: Callable[[str], str], **options) -> Ladder:
    return Ladder(call, **options)
