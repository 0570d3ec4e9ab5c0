"""Queries on the translation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitile.functions.keys import LANGUAGES, clean_key, content_checksum, parse_language
from lexitile.operators import memory as M
from lexitile.sources.tables import table

#: Keyword and file of the clearing queries.
KEYWORD = "note"


def _long(spark: SparkSession, d: str) -> DataFrame:
    return M.to_long(table(spark, d, "correspondence"))


def _store(spark: SparkSession, d: str) -> DataFrame:
    """Chunks held now, each delivered row once."""
    return table(spark, d, "chunk_store").where("removed_at is null").select("store_id", "lang", "path_checksum", "checksum", "content").dropDuplicates(["store_id"])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "recovered_pairs").select("pair_id", "path_checksum", "src_checksum", "src_lang", "tgt_lang", "tgt_text", "recovered_at").dropDuplicates(["pair_id"])
    return p.select(
        F.col("pair_id").alias("request_id"), clean_key(F.col("path_checksum")).alias("path"), "src_lang", clean_key(F.col("src_checksum")).alias("src_checksum"), parse_language(F.trim("tgt_lang")).alias("tgt_lang"),
        content_checksum(F.col("tgt_text")).alias("new"), "recovered_at",
    )


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("tgt_lang is not null and src_checksum != ''")


def q_flagship(spark: SparkSession, d: str) -> DataFrame:
    """By language: chunks of the corpus (lines), distinct ones, and those reusable from a memory of half of the documents."""
    docs = table(spark, d, "documents").where("text is not null and lang is not null").select("doc_id", "lang", F.coalesce("source", F.lit("")).alias("path"), F.explode(F.split("text", "\n")).alias("line"))
    lines = docs.select("lang", "path", content_checksum(F.col("line")).alias("checksum"), (F.floor(F.col("doc_id") / 20) % 2 == 0).alias("stored"))
    # One pass: counts by (language, path, checksum), then by (language, checksum); no join of the corpus with itself.
    by_path = lines.groupBy("lang", "checksum", "path").agg(F.count_if("stored").alias("kept"), F.count_if(~F.col("stored")).alias("asked"))
    by_text = by_path.groupBy("lang", "checksum").agg(
        F.sum(F.col("kept") + F.col("asked")).alias("n"), F.sum("asked").alias("asked"), F.sum(F.when(F.col("kept") > 0, F.col("asked")).otherwise(0)).alias("path_hits"), F.sum("kept").alias("kept")
    )
    return by_text.groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"), F.sum("asked").alias("n_requests"), F.sum("path_hits").alias("path_hits"), F.sum(F.when(F.col("kept") > 0, F.col("asked")).otherwise(0)).alias("lang_hits"))


def q_chunk_store(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "chunk_store").dropDuplicates(["store_id"])
    key = F.struct(clean_key(F.col("path_checksum")), clean_key(F.col("checksum")))
    return s.groupBy("lang").agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(content_checksum(F.col("content")) == F.col("checksum")).alias("n_true"))


def q_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    return M.lookup(_requests(spark, d), _long(spark, d))


def q_lookup_text(spark: SparkSession, d: str) -> DataFrame:
    return M.lookup_text(_requests(spark, d), _long(spark, d), _store(spark, d)).select("request_id", content_checksum(F.col("content")).alias("text_sha"))


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = _requests(spark, d).where("new is not null").select(F.struct("recovered_at", "request_id").alias("seq"), "path", "src_lang", "src_checksum", "tgt_lang", F.col("new").alias("tgt_checksum"))
    return M.upsert(_long(spark, d), p).withColumn("row_id", F.coalesce("row_id", F.lit(-1).cast("bigint")))


def q_corr_wide(spark: SparkSession, d: str) -> DataFrame:
    return M.to_wide(_long(spark, d))


def q_drop_lang(spark: SparkSession, d: str) -> DataFrame:
    return M.to_wide(M.drop_language(_long(spark, d), "German"))


def q_new_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "recovered_pairs").where("tgt_text is not null").select(parse_language(F.trim("tgt_lang")).alias("lang"), clean_key(F.col("path_checksum")).alias("path"), content_checksum(F.col("tgt_text")).alias("checksum"))
    return M.new_chunks(p.where("lang is not null"), _store(spark, d))


def q_sync_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.recover_pairs(_pairs(spark, d), _store(spark, d)).select("request_id", "store_id", "store_lang")


def q_sync_missing(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("src_checksum != ''").join(M.first_sources(_store(spark, d)).select(F.col("checksum").alias("src_checksum")), "src_checksum", "left_anti").select("request_id")


def q_sync_counters(spark: SparkSession, d: str) -> DataFrame:
    p = M.recover_pairs(_requests(spark, d), _store(spark, d))
    return p.groupBy("tgt_lang").agg(F.count("*").alias("n_pairs"), F.countDistinct("path").alias("n_files"))


def q_clear_missing_rows(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_missing(_long(spark, d), _store(spark, d), "English")[2]


def q_clear_missing_orphans(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_missing(_long(spark, d), _store(spark, d), "English")[1]


def q_clear_missing_kept(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_missing(_long(spark, d), _store(spark, d), "English")[0]


def q_clear_lang(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_all(_long(spark, d), _store(spark, d), lang="French")[0]


def _a_path(spark: SparkSession, d: str) -> str:
    r = table(spark, d, "correspondence").agg(F.max(clean_key(F.col("path_checksum")))).first()
    return r[0] or ""


def q_clear_file(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_all(_long(spark, d), _store(spark, d), path=_a_path(spark, d))[0]


def q_clear_lang_file(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_all(_long(spark, d), _store(spark, d), lang="French", path=_a_path(spark, d))[0]


def q_clear_keyword(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_all(_long(spark, d), _store(spark, d), keyword=KEYWORD)[0]


def q_clear_keyword_chunks(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_all(_long(spark, d), _store(spark, d), keyword=KEYWORD)[1]


def q_correct(spark: SparkSession, d: str) -> DataFrame:
    return M.corrections(_requests(spark, d).where("new is not null"), _long(spark, d))


def q_review_flag(spark: SparkSession, d: str) -> DataFrame:
    req = _requests(spark, d)
    hits = M.lookup(req, _long(spark, d)).where("tgt_checksum is not null").select("request_id", F.lit(True).alias("hit"))
    cells = req.join(hits, "request_id", "left").select(F.col("request_id").alias("cell_id"), F.concat_ws("|", "path", "tgt_lang").alias("path"), "src_checksum", F.col("request_id").alias("ordinal"), F.coalesce("hit", F.lit(False)).alias("hit"), F.col("new").isNull().alias("failed"))
    previous = cells.select("path", "src_checksum", "ordinal", F.col("failed").alias("needs_review"))
    return M.review_flags(cells, previous)


def q_first_target_meta(spark: SparkSession, d: str) -> DataFrame:
    """Existing-target metadata: the first cell of each source checksum in a file and language."""
    return M.first_cells(_requests(spark, d).select("request_id", "path", "tgt_lang", "src_checksum"), ["path", "tgt_lang", "src_checksum"], "request_id")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_K = "lower(trim(coalesce({}, '')))"
_LONG = " UNION ALL ".join(f"SELECT row_id, {_K.format('path_checksum')} AS path, '{n}' AS lang, {_K.format(n.lower())} AS checksum FROM correspondence" for n in LANGUAGES)
_CASE = "CASE lower(trim(tgt_lang)) " + " ".join(f"WHEN '{n.lower()}' THEN '{n}'" for n in LANGUAGES) + " END"
_WITH = f"""WITH long AS (SELECT * FROM ({_LONG}) WHERE checksum <> ''),
store AS (SELECT DISTINCT store_id, lang, {_K.format('path_checksum')} AS path, {_K.format('checksum')} AS checksum, content FROM chunk_store WHERE removed_at IS NULL),
pairs AS (SELECT DISTINCT pair_id AS request_id, {_K.format('path_checksum')} AS path, src_lang, {_K.format('src_checksum')} AS src_checksum, {_CASE} AS tgt_lang, sha256(tgt_text) AS new, recovered_at FROM recovered_pairs),
req AS (SELECT * FROM pairs WHERE tgt_lang IS NOT NULL AND src_checksum <> ''),
firsts AS (SELECT request_id, any_value(r.path) AS path, any_value(r.tgt_lang) AS tgt_lang, any_value(r.new) AS new, min(l.row_id) AS row_id FROM req r JOIN long l
  ON l.lang = r.src_lang AND l.checksum = r.src_checksum AND (l.path = r.path OR l.path = '') WHERE r.src_lang <> r.tgt_lang GROUP BY request_id),
looked AS (SELECT f.*, l.checksum AS tgt_checksum FROM firsts f LEFT JOIN long l ON l.row_id = f.row_id AND l.lang = f.tgt_lang),
held AS (SELECT DISTINCT lang, path, checksum FROM store),
src1 AS (SELECT checksum, min(store_id) AS store_id, arg_min(lang, store_id) AS store_lang FROM store GROUP BY checksum),
cells AS (SELECT l.*, h.lang IS NOT NULL AS held FROM long l LEFT JOIN held h USING (lang, path, checksum)),
rows_ AS (SELECT row_id, bool_or(lang = 'English' AND held) AS src_held, count(*) FILTER (lang <> 'English' AND held) AS n_held, count(*) FILTER (lang <> 'English' AND NOT held) AS n_gone FROM cells GROUP BY row_id),
kept AS (SELECT row_id, path, lang, checksum FROM cells WHERE held AND row_id IN (SELECT row_id FROM rows_ WHERE src_held AND n_held > 0)),
orphans AS (SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.lang = h.lang AND k.path = h.path AND k.checksum = h.checksum))
"""
_WIDE = ", ".join(f"coalesce(max(checksum) FILTER (lang = '{n}'), '') AS {n.lower()}" for n in LANGUAGES)
_PATH = f"(SELECT max({_K.format('path_checksum')}) FROM correspondence)"
ORACLES = {
    "q_flagship": """WITH lines AS (SELECT lang, coalesce(source, '') AS path, sha256(unnest(string_split(text, chr(10)))) AS checksum, (doc_id // 20) % 2 = 0 AS stored FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
mp AS (SELECT DISTINCT lang, path, checksum FROM lines WHERE stored), ml AS (SELECT DISTINCT lang, checksum FROM mp)
SELECT l.lang, count(*) AS n_chunks, count(DISTINCT l.checksum) AS n_distinct, count(*) FILTER (NOT stored) AS n_requests,
 count(*) FILTER (NOT stored AND mp.lang IS NOT NULL) AS path_hits, count(*) FILTER (NOT stored AND ml.lang IS NOT NULL) AS lang_hits
FROM lines l LEFT JOIN mp USING (lang, path, checksum) LEFT JOIN ml ON ml.lang = l.lang AND ml.checksum = l.checksum GROUP BY l.lang""",
    "q_chunk_store": f"""SELECT lang, count(*) AS n_rows, count(DISTINCT ({_K.format('path_checksum')}, {_K.format('checksum')})) AS n_keys, count(*) FILTER (sha256(content) = checksum) AS n_true
FROM (SELECT DISTINCT store_id, lang, path_checksum, checksum, content FROM chunk_store) GROUP BY lang""",
    "q_exact_lookup": _WITH + "SELECT request_id, row_id, tgt_checksum FROM looked",
    "q_lookup_text": _WITH + "SELECT request_id, sha256(max(s.content)) AS text_sha FROM looked k JOIN store s ON s.lang = k.tgt_lang AND s.path = k.path AND s.checksum = k.tgt_checksum GROUP BY request_id",
    "q_upsert": _WITH + """, p AS (SELECT * FROM req WHERE new IS NOT NULL AND src_lang <> tgt_lang),
cell AS (SELECT path, src_lang, src_checksum, tgt_lang, arg_max(new, (recovered_at, request_id)) AS tgt_checksum FROM p GROUP BY ALL),
claim AS (SELECT path, src_lang, src_checksum, min((recovered_at, request_id)) AS seq FROM p GROUP BY ALL),
own AS (SELECT path, lang AS src_lang, checksum AS src_checksum, min(row_id) AS own FROM long GROUP BY ALL),
wild AS (SELECT lang AS src_lang, checksum AS src_checksum, min(row_id) AS wild FROM long WHERE path = '' GROUP BY ALL),
c AS (SELECT claim.*, own, wild, path <> '' AND wild IS NOT NULL AND (own IS NULL OR wild < own) AS wants FROM claim LEFT JOIN own USING (path, src_lang, src_checksum) LEFT JOIN wild USING (src_lang, src_checksum)),
w AS (SELECT src_lang, src_checksum, arg_min(path, seq) AS winner FROM c WHERE wants GROUP BY ALL)
SELECT cell.*, coalesce(CASE WHEN wants AND winner = path THEN wild ELSE own END, -1) AS row_id, coalesce(wants AND winner = path, false) AS adopted
FROM cell JOIN c USING (path, src_lang, src_checksum) LEFT JOIN w USING (src_lang, src_checksum)""",
    "q_corr_wide": _WITH + f"SELECT row_id, path AS path_checksum, {_WIDE} FROM long GROUP BY row_id, path",
    "q_drop_lang": _WITH + f"SELECT row_id, path AS path_checksum, {_WIDE} FROM long WHERE lang <> 'German' GROUP BY row_id, path",
    "q_new_chunks": _WITH + "SELECT DISTINCT tgt_lang AS lang, path, new AS checksum FROM pairs p WHERE tgt_lang IS NOT NULL AND new IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = p.tgt_lang AND h.path = p.path AND h.checksum = p.new)",
    "q_sync_pairs": _WITH + "SELECT request_id, store_id, store_lang FROM pairs JOIN src1 ON src1.checksum = pairs.src_checksum",
    "q_sync_missing": _WITH + "SELECT request_id FROM pairs WHERE src_checksum <> '' AND src_checksum NOT IN (SELECT checksum FROM src1)",
    "q_sync_counters": _WITH + "SELECT tgt_lang, count(*) AS n_pairs, count(DISTINCT path) AS n_files FROM req JOIN src1 ON src1.checksum = req.src_checksum GROUP BY tgt_lang",
    "q_clear_missing_rows": _WITH + """SELECT (SELECT count(*) FROM rows_ WHERE NOT (src_held AND n_held > 0)) AS removed_rows, (SELECT coalesce(sum(n_gone), 0)::BIGINT FROM rows_ WHERE src_held AND n_held > 0) AS cleared_fields,
(SELECT count(*) FROM orphans WHERE lang = 'English') AS removed_source_chunks, (SELECT count(*) FROM orphans WHERE lang <> 'English') AS removed_target_chunks""",
    "q_clear_missing_orphans": _WITH + "SELECT * FROM orphans",
    "q_clear_missing_kept": _WITH + "SELECT * FROM kept",
    "q_clear_lang": _WITH + "SELECT * FROM long WHERE lang <> 'French'",
    "q_clear_file": _WITH + f"SELECT * FROM long WHERE path <> {_PATH}",
    "q_clear_lang_file": _WITH + f"SELECT * FROM long WHERE NOT (lang = 'French' AND path = {_PATH})",
    "q_clear_keyword": _WITH + f"SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.lang = l.lang AND s.path = l.path AND s.checksum = l.checksum AND contains(s.content, '{KEYWORD}'))",
    "q_clear_keyword_chunks": _WITH + f"SELECT DISTINCT lang, path, checksum FROM store WHERE contains(content, '{KEYWORD}')",
    "q_correct": _WITH + "SELECT request_id, tgt_checksum AS old, new FROM looked WHERE tgt_checksum IS NOT NULL AND new IS NOT NULL AND new <> tgt_checksum",
    "q_review_flag": _WITH + """, c AS (SELECT r.request_id, r.path, r.tgt_lang, r.src_checksum, k.tgt_checksum IS NOT NULL AS hit, r.new IS NULL AS failed FROM req r LEFT JOIN looked k USING (request_id)),
f AS (SELECT *, first_value(hit) OVER w AS from_cache, first_value(failed) OVER w AS old FROM c WINDOW w AS (PARTITION BY path, tgt_lang, src_checksum ORDER BY request_id))
SELECT request_id AS cell_id, CASE WHEN failed THEN 'not-translated-due-to-exception' WHEN NOT from_cache OR old THEN 'needs_review' ELSE '' END AS flag FROM f""",
    "q_first_target_meta": _WITH + "SELECT request_id, path, tgt_lang, src_checksum FROM req QUALIFY row_number() OVER (PARTITION BY path, tgt_lang, src_checksum ORDER BY request_id) = 1",
}
