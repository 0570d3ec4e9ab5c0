"""The translation memory as tables: lookup, upsert, synchronisation, correction and clearing.

The correspondence table is kept long, ``row_id, path, lang, checksum`` (one row a filled cell), so a new language needs no new
column; ``to_wide`` and ``to_long`` convert at the edge. '' is the wildcard path.

Defined cases: NULL paths are wildcards, NULL and blank checksums are empty cells; repeated rows give the result once;
equal source and target language is a miss; empty tables give empty results (counters are 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitile.functions.keys import LANGUAGES, clean_key


def to_long(wide: DataFrame, langs: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``row_id, path, lang, checksum`` of the filled cells of a wide correspondence table."""
    cells = F.array(*[F.struct(F.lit(n).alias("lang"), clean_key(F.col(n.lower())).alias("checksum")) for n in langs])
    long = wide.select("row_id", clean_key(F.col("path_checksum")).alias("path"), F.explode(cells).alias("c"))
    return long.select("row_id", "path", "c.lang", "c.checksum").where("checksum != ''")


def to_wide(long: DataFrame, langs: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """One row a ``row_id`` with a column for each language, '' for empty cells; the fixed list keeps the schema stable."""
    cols = [F.coalesce(F.max(F.when(F.col("lang") == n, F.col("checksum"))), F.lit("")).alias(n.lower()) for n in langs]
    return long.groupBy("row_id", F.col("path").alias("path_checksum")).agg(*cols)


def drop_language(long: DataFrame, lang: str) -> DataFrame:
    return long.where(F.col("lang") != lang)


def lookup(requests: DataFrame, long: DataFrame) -> DataFrame:
    """``request_id, row_id, tgt_checksum``: the first row in file order that holds the source under the request's path or the wildcard.

    ``requests`` has ``request_id, path, src_lang, src_checksum, tgt_lang``. Two equi-joins replace the alternative in the
    condition. A first row without a target is a miss; later rows are not tried.
    """
    r = requests.where(F.col("src_lang") != F.col("tgt_lang"))
    src = long.select("row_id", F.col("path").alias("row_path"), F.col("lang").alias("src_lang"), F.col("checksum").alias("src_checksum"))
    exact = r.join(src.withColumnRenamed("row_path", "path"), ["path", "src_lang", "src_checksum"])
    wild = r.where("path != ''").join(src.where("row_path = ''").drop("row_path"), ["src_lang", "src_checksum"])
    hits = exact.select("request_id", "tgt_lang", "row_id").unionByName(wild.select("request_id", "tgt_lang", "row_id"))
    first = hits.groupBy("request_id", "tgt_lang").agg(F.min("row_id").alias("row_id"))
    tgt = long.select("row_id", F.col("lang").alias("tgt_lang"), F.col("checksum").alias("tgt_checksum"))
    return first.join(tgt, ["row_id", "tgt_lang"], "left").select("request_id", "row_id", "tgt_checksum")


def lookup_text(requests: DataFrame, long: DataFrame, store: DataFrame) -> DataFrame:
    """``request_id, content``: lookup and text of the target; a target without a chunk is a miss."""
    found = lookup(requests, long).where("tgt_checksum is not null").join(requests.select("request_id", "path", F.col("tgt_lang").alias("lang")), "request_id")
    chunks = store.groupBy("lang", clean_key(F.col("path_checksum")).alias("path"), clean_key(F.col("checksum")).alias("tgt_checksum")).agg(F.max("content").alias("content"))
    return found.join(chunks, ["lang", "path", "tgt_checksum"]).select("request_id", "content")


def upsert(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """Batch upsert of ``seq, path, src_lang, src_checksum, tgt_lang, tgt_checksum``: one row a written cell.

    Result: ``path, src_lang, src_checksum, tgt_lang, tgt_checksum, row_id, adopted``; ``row_id`` is NULL for rows to append. The last
    write of a cell wins. A source key goes to its first row in file order; a wildcard row goes to the claimant that comes first
    and takes its path, later claimants get their own exact row or a new one.
    """
    key = ["path", "src_lang", "src_checksum"]
    p = pairs.where((F.col("src_lang") != F.col("tgt_lang")) & (F.col("src_checksum") != "") & (F.col("tgt_checksum") != ""))
    cells = p.groupBy(*key, "tgt_lang").agg(F.max(F.struct("seq", "tgt_checksum"))["tgt_checksum"].alias("tgt_checksum"))
    claims = p.groupBy(*key).agg(F.min("seq").alias("seq"))
    src = long.select("row_id", F.col("path").alias("row_path"), F.col("lang").alias("src_lang"), F.col("checksum").alias("src_checksum"))
    exact = src.groupBy(F.col("row_path").alias("path"), "src_lang", "src_checksum").agg(F.min("row_id").alias("own"))
    wild = src.where("row_path = ''").groupBy("src_lang", "src_checksum").agg(F.min("row_id").alias("wild"))
    c = claims.join(exact, key, "left").join(wild, ["src_lang", "src_checksum"], "left")
    wants = (F.col("path") != "") & F.col("wild").isNotNull() & (F.col("own").isNull() | (F.col("wild") < F.col("own")))
    winner = c.where(wants).groupBy("src_lang", "src_checksum").agg(F.min(F.struct("seq", "path"))["path"].alias("winner"))
    c = c.join(winner, ["src_lang", "src_checksum"], "left")
    adopted = wants & (F.col("winner") == F.col("path"))
    c = c.select(*key, F.when(adopted, F.col("wild")).otherwise(F.col("own")).alias("row_id"), F.coalesce(adopted, F.lit(False)).alias("adopted"))
    return cells.join(c, key)


def new_chunks(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """Content-addressed write: distinct ``lang, path, checksum, content`` that the store lacks."""
    held = store.select("lang", clean_key(F.col("path_checksum")).alias("path"), clean_key(F.col("checksum")).alias("checksum")).distinct()
    return candidates.dropDuplicates(["lang", "path", "checksum"]).join(held, ["lang", "path", "checksum"], "left_anti")


def first_sources(store: DataFrame) -> DataFrame:
    """The first chunk of each checksum in store order: ``checksum, store_id, lang``."""
    return store.groupBy(clean_key(F.col("checksum")).alias("checksum")).agg(F.min(F.struct("store_id", "lang")).alias("f")).select("checksum", "f.store_id", "f.lang")


def recover_pairs(targets: DataFrame, store: DataFrame) -> DataFrame:
    """Target cells joined with the first source of their checksum: every target stays, each source counts once."""
    return targets.join(first_sources(store).withColumnRenamed("checksum", "src_checksum").withColumnRenamed("lang", "store_lang"), "src_checksum")


def clear_missing(long: DataFrame, store: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clearing of cells whose chunk is gone: ``(kept cells, orphan chunks, counters)``.

    A row goes if its source is empty or gone, or if none of its targets is held; other gone targets are blanked. Chunks that
    no kept cell refers to are orphans.
    """
    held = store.select("lang", clean_key(F.col("path_checksum")).alias("path"), clean_key(F.col("checksum")).alias("checksum")).distinct()
    cells = long.join(held.withColumn("held", F.lit(True)), ["lang", "path", "checksum"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    is_src = F.col("lang") == source
    rows = cells.groupBy("row_id").agg(F.max(is_src & F.col("held")).alias("src_held"), F.count_if(~is_src & F.col("held")).alias("n_held"), F.count_if(~is_src & ~F.col("held")).alias("n_gone"))
    keep = F.col("src_held") & (F.col("n_held") > 0)
    kept = cells.where("held").join(rows.where(keep).select("row_id"), "row_id", "left_semi").select("row_id", "path", "lang", "checksum")
    orphans = held.join(kept.select("lang", "path", "checksum").distinct(), ["lang", "path", "checksum"], "left_anti")
    zero = F.lit(0).cast("bigint")
    a = rows.select((~keep).cast("bigint").alias("removed_rows"), F.when(keep, F.col("n_gone")).otherwise(0).alias("cleared_fields"), zero.alias("removed_source_chunks"), zero.alias("removed_target_chunks"))
    b = orphans.select(zero.alias("removed_rows"), zero.alias("cleared_fields"), (F.col("lang") == source).cast("bigint").alias("removed_source_chunks"), (F.col("lang") != source).cast("bigint").alias("removed_target_chunks"))
    flags = a.unionByName(b)
    return kept, orphans, flags.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in flags.columns])


def clear_all(long: DataFrame, store: DataFrame, lang: str | None = None, path: str | None = None, keyword: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Clearing by language, file and literal keyword: ``(kept cells, deleted chunks)``.

    Wildcard rows stay when a file is given. With a keyword only cells whose chunk holds it are cleared; without one, rows of a
    file go whole unless a language is given.
    """
    chunks = store.select("lang", clean_key(F.col("path_checksum")).alias("path"), clean_key(F.col("checksum")).alias("checksum"), "content")
    in_scope = F.lit(True)
    if lang is not None:
        in_scope &= F.col("lang") == lang
    if path is not None:
        in_scope &= F.col("path") == path
    gone = chunks.where(in_scope & (F.col("content").contains(keyword) if keyword is not None else F.lit(True))).select("lang", "path", "checksum").distinct()
    if keyword is None:
        return long.where(~in_scope), gone
    return long.join(gone, ["lang", "path", "checksum"], "left_anti").select("row_id", "path", "lang", "checksum"), gone


def corrections(targets: DataFrame, long: DataFrame) -> DataFrame:
    """``request_id, old, new``: target cells whose text no longer has the checksum on record."""
    found = lookup(targets, long).where("tgt_checksum is not null")
    return found.join(targets.select("request_id", "new"), "request_id").where(F.col("tgt_checksum") != F.col("new")).select("request_id", F.col("tgt_checksum").alias("old"), "new")


def first_cells(cells: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first cell in order of each group of keys."""
    rest = [c for c in cells.columns if c not in (*keys, *order)]
    return cells.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("f")).select(*keys, *[f"f.{c}" for c in (*order, *rest)])


def review_flags(cells: DataFrame, previous: DataFrame) -> DataFrame:
    """Review metadata of new cells: a new translation is flagged, a hit keeps its old flag, a failure names itself.

    ``cells``: ``cell_id, path, src_checksum, ordinal, hit, failed``; ``previous``: ``path, src_checksum, ordinal, needs_review``. Of
    repeated chunks in a file the first decides whether it came from memory; of old cells with one checksum the first counts.
    """
    key = ["path", "src_checksum"]
    old = first_cells(previous.select(*key, "ordinal", "needs_review"), key, "ordinal").select(*key, F.col("needs_review").alias("old"))
    first = first_cells(cells.select(*key, "ordinal", "cell_id", "hit"), key, "ordinal", "cell_id").select(*key, F.col("hit").alias("from_cache"))
    flag = F.when(F.col("failed"), "not-translated-due-to-exception").when(~F.col("from_cache"), "needs_review").when(F.col("old"), "needs_review").otherwise("")
    return cells.join(first, key, "left").join(old, key, "left").select("cell_id", flag.alias("flag"))


def keyword_filter(c: Column, keyword: str) -> Column:
    """Literal, case-sensitive; NULL text holds nothing."""
    return F.coalesce(c.contains(keyword), F.lit(False))
