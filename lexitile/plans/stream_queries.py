"""Queries of the change feed, translation and fuzzy search, run as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitile.operators.fuzzy import best_matches
from lexitile.operators.translation import Ladder, translate_snapshot
from lexitile.sources.tables import table
from lexitile.streaming.feeds import first_deliveries, sessions, tumbling_counts


def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return tumbling_counts(table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


def q_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return first_deliveries(table(spark, d, "recovered_pairs"), ["pair_id"], "loaded_at").groupBy("chunk_type").agg(F.count("*").alias("n"))


def q_fuzzy_best(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk whose id is divisible by 50 against all other chunks of its language and file."""
    s = table(spark, d, "chunk_store").where("content is not null and path_checksum is not null").select("store_id", "lang", F.lower(F.trim("path_checksum")).alias("path"), "content").dropDuplicates(["store_id"])
    asked = s.where("store_id % 50 = 0").withColumnRenamed("store_id", "query_id")
    return best_matches(asked, s, ["lang", "path"], gate=0.0, own="store_id")


def q_fuzzy_lang(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk whose id is divisible by 50 against all other chunks of its language, without a gate."""
    s = table(spark, d, "chunk_store").where("content is not null").select("store_id", "lang", "content").dropDuplicates(["store_id"])
    asked = s.where("store_id % 50 = 0").withColumnRenamed("store_id", "query_id")
    return best_matches(asked, s, ["lang"], gate=0.0, own="store_id")


def echo(prompt: str) -> str:
    """A stand-in model: gives the unit back with its text in capitals left as it is."""
    a, b = prompt.find("<document>"), prompt.rfind("</document>")
    return f"<output>\n{prompt[a : b + len('</document>')]}</output>"


def _translated(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "recovered_pairs").select("pair_id", "path_checksum", "src_lang", "chunk_type", "src_text").dropDuplicates(["pair_id"])
    chunks = p.select(F.col("pair_id").alias("chunk_id"), F.coalesce("path_checksum", F.lit("")).alias("path"), "src_lang", F.lit("French").alias("tgt_lang"), F.col("chunk_type").alias("kind"), F.col("src_text").alias("content"))
    memory = chunks.where("chunk_id % 3 = 0 and src_lang != 'French' and content is not null").select("path", "src_lang", "tgt_lang", "content", F.concat(F.lit("M:"), "content").alias("translated"))
    return translate_snapshot(chunks, memory, Ladder(echo)).select("chunk_id", F.sha2("translated", 256).alias("sha"), "from_cache", "status")


def q_translate_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All recovered sources through the translation pipeline with a stand-in model."""
    return _translated(spark, d)


def q_translate_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the same pipeline: from the memory, or the unit sent to the model and rebuilt from its answer, which here is the source again."""
    return _translated(spark, d).select("chunk_id", "sha", (F.col("status") == "cached").alias("cached"), (F.col("status") == "failed").alias("failed"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "q_stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "q_translate_texts": """WITH p AS (SELECT DISTINCT pair_id, coalesce(path_checksum, '') AS path, src_lang, src_text FROM recovered_pairs),
m AS (SELECT DISTINCT path, src_lang, src_text FROM p WHERE pair_id % 3 = 0 AND src_lang <> 'French' AND src_text IS NOT NULL),
c AS (SELECT *, src_lang <> 'French' AND (EXISTS (SELECT 1 FROM m WHERE m.path = p.path AND m.src_lang = p.src_lang AND m.src_text = p.src_text) OR EXISTS (SELECT 1 FROM m WHERE m.path = '' AND m.src_lang = p.src_lang AND m.src_text = p.src_text)) AS hit FROM p)
SELECT pair_id AS chunk_id, sha256(CASE WHEN hit THEN 'M:' || src_text ELSE src_text END) AS sha, src_text IS NOT NULL AND hit AS cached, false AS failed FROM c""",
    "q_first_deliveries": "SELECT chunk_type, count(DISTINCT pair_id) AS n FROM recovered_pairs GROUP BY chunk_type",
}
