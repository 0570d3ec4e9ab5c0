"""Queries on paths, prompts, replies and vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitile.functions import text as X
from lexitile.functions.keys import content_checksum, dir_suffix, document_type, is_blank, normalize_path, parse_language, path_checksum
from lexitile.operators.translation import Ladder, Overloaded
from lexitile.sources.files import copy_plan, stale_files
from lexitile.sources.tables import table


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "path_map").where("rel_path is not null")


def q_path_register(spark: SparkSession, d: str) -> DataFrame:
    """Distinct normalised paths by their checksum; more than one path under a checksum would be a collision."""
    p = _paths(spark, d).select(normalize_path(F.trim("rel_path")).alias("p"))
    return p.groupBy(F.sha2("p", 256).alias("path_sha")).agg(F.min("p").alias("path"), F.countDistinct("p").alias("n_paths"), F.count("*").alias("n_rows"))


def q_doc_type(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).groupBy(document_type(F.trim("rel_path")).alias("doc_type")).agg(F.count("*").alias("n"))


def q_basename_match(spark: SparkSession, d: str) -> DataFrame:
    """Files matched by base name: the first path of each name."""
    p = _paths(spark, d).select(normalize_path(F.trim("rel_path")).alias("path")).distinct()
    name = F.regexp_extract("path", "[^/]+$", 0)
    return p.groupBy(name.alias("name")).agg(F.min("path").alias("path"), F.count("*").alias("n"))


def q_untranslatable(spark: SparkSession, d: str) -> DataFrame:
    """Registered paths without any recovered pair."""
    used = table(spark, d, "recovered_pairs").select(F.lower(F.trim("path_checksum")).alias("k")).where("k is not null").distinct()
    known = _paths(spark, d).select(F.lower(F.trim("path_checksum")).alias("rel_path")).distinct()
    return copy_plan(known, used.withColumnRenamed("k", "rel_path")).select(F.col("rel_path").alias("k"))


def q_mirror_delete(spark: SparkSession, d: str) -> DataFrame:
    """Chunk keys of target languages whose path has no chunk in English."""
    s = table(spark, d, "chunk_store").select("lang", F.lower(F.trim("path_checksum")).alias("path")).where("path != ''")
    s = s.withColumnRenamed("path", "rel_path").distinct()
    return stale_files(s.where("lang != 'English'"), s.where("lang = 'English'")).select("lang", F.col("rel_path").alias("path"))


def _vocabulary(spark: SparkSession, d: str, tgt: str = "french") -> DataFrame:
    """``src=tgt`` lines of the vocabulary in row order; the table has a fixed number of rows."""
    v = table(spark, d, "vocabulary").where(F.col("english").isNotNull() & F.col(tgt).isNotNull())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_id", F.concat("english", F.lit("="), F.col(tgt), F.lit("\n")).alias("line")))), lambda x: x["line"])
    return v.agg(F.array_join(lines, "").alias("terms"))


def q_vocab(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d)


def q_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Plain prompts of the recovered sources."""
    p = table(spark, d, "recovered_pairs").where("src_text is not null").select("pair_id", "src_text", "src_lang", "chunk_type").dropDuplicates(["pair_id"])
    terms = _vocabulary(spark, d).first()[0]
    prompt = X.fill(F.lit(X.PLAIN_PROMPT), content_type=F.col("chunk_type"), source=F.col("src_lang"), target=F.lit("French"), vocabulary=F.lit(terms))
    return p.select("pair_id", content_checksum(X.plain_prompt(prompt, F.col("src_text"))).alias("sha"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "recovered_pairs").where("tgt_text is not null").select("pair_id", "tgt_text").dropDuplicates(["pair_id"])
    form = F.col("pair_id") % 4
    reply = F.when(form == 0, F.concat(F.lit("Sure.\n<output>\n"), "tgt_text", F.lit("</output> and <output>x</output>"))).when(form == 1, F.concat(F.lit("<output>"), "tgt_text"))
    return p.select("pair_id", reply.when(form == 2, F.concat(F.lit("a<document>"), "tgt_text", F.lit("</document>b"))).otherwise(F.col("tgt_text")).alias("reply"))


def q_response_extract(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("pair_id", content_checksum(X.reply_text(F.col("reply"))).alias("sha"))


def q_between_tags(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("pair_id", content_checksum(X.between_tags(F.col("reply"), "<document>", "</document>")).alias("sha"))


def q_prefix_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", content_checksum(X.prefix_lines(F.col("text"), "> ")).alias("sha"))


def q_byte_slice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "typst_chunks").where("content is not null").select("chunk_id", "content").dropDuplicates(["chunk_id"])
    n = F.octet_length(F.substr("content", F.lit(1), F.lit(40)))
    return c.select("chunk_id", content_checksum(X.byte_slice(F.col("content"), F.lit(0), n)).alias("sha"))


def q_byte_slices(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every chunk as the slice between its byte offsets."""
    c = table(spark, d, "typst_chunks").where("content is not null").select("chunk_id", "content").dropDuplicates(["chunk_id"])
    ends = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(y) + 1)))
    c = c.select("chunk_id", "content", F.split("content", "\n").alias("lines"))
    line = c.select("chunk_id", "content", F.posexplode(F.slice(ends(F.col("lines")), 1, F.size("lines"))).alias("line", "start"), F.col("lines"))
    line = line.select("chunk_id", F.col("line").cast("bigint").alias("line"), X.byte_slice(F.col("content"), F.col("start"), F.col("start") + F.octet_length(F.get("lines", F.col("line")))).alias("slice"))
    return line.select("chunk_id", "line", content_checksum(F.col("slice")).alias("sha"))


def q_languages(spark: SparkSession, d: str) -> DataFrame:
    """Labels parsed as languages, with directory suffix and blank labels."""
    p = table(spark, d, "recovered_pairs").select("pair_id", "tgt_lang").dropDuplicates(["pair_id"])
    lang = parse_language(F.col("tgt_lang"))
    return p.groupBy(lang.alias("lang"), dir_suffix(lang).alias("suffix"), F.coalesce(is_blank(F.col("tgt_lang")), F.lit(True)).alias("blank")).agg(F.count("*").alias("n"))


def q_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Waiting times before each further attempt, as a ladder with an ever overloaded model takes them."""
    waits: list[float] = []

    def overloaded(_: str) -> str:
        raise Overloaded

    ladder = Ladder(overloaded, sleep=waits.append)
    try:
        ladder.patient(overloaded, "")
    except Overloaded:
        pass
    return spark.createDataFrame([(n, int(w)) for n, w in enumerate(waits)], "attempt long, seconds long")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(rel_path), '/{2,}', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', ''), '(.)/(\.)?$', '\1')"
_VOCAB = "(SELECT coalesce(string_agg(english || '=' || french || chr(10), '' ORDER BY row_id), '') FROM vocabulary)"
_REPLY = """WITH r AS (SELECT pair_id, CASE pair_id % 4 WHEN 0 THEN 'Sure.' || chr(10) || '<output>' || chr(10) || tgt_text || '</output> and <output>x</output>' WHEN 1 THEN '<output>' || tgt_text
 WHEN 2 THEN 'a<document>' || tgt_text || '</document>b' ELSE tgt_text END AS reply FROM (SELECT DISTINCT pair_id, tgt_text FROM recovered_pairs WHERE tgt_text IS NOT NULL))"""
_STRIP = r"regexp_replace({}, '^[ \t\n\x0B\f\r\x1C-\x1F\x{{85}}\p{{Z}}]+|[ \t\n\x0B\f\r\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"
ORACLES = {
    "q_path_register": f"SELECT sha256(p) AS path_sha, min(p) AS path, count(DISTINCT p) AS n_paths, count(*) AS n_rows FROM (SELECT {_NORM} AS p FROM path_map WHERE rel_path IS NOT NULL) GROUP BY 1",
    "q_doc_type": r"SELECT CASE regexp_extract(trim(rel_path), '[^/]\.([^./]+)$', 1) WHEN 'tex' THEN 'latex' WHEN 'ipynb' THEN 'jupyter' WHEN 'typ' THEN 'typst' WHEN 'md' THEN 'markdown' ELSE 'other' END AS doc_type, count(*) AS n FROM path_map WHERE rel_path IS NOT NULL GROUP BY 1",
    "q_basename_match": f"SELECT regexp_extract(p, '[^/]+$') AS name, min(p) AS path, count(*) AS n FROM (SELECT DISTINCT {_NORM} AS p FROM path_map WHERE rel_path IS NOT NULL) GROUP BY 1",
    "q_untranslatable": "SELECT DISTINCT lower(trim(path_checksum)) AS k FROM path_map WHERE rel_path IS NOT NULL AND lower(trim(path_checksum)) NOT IN (SELECT lower(trim(path_checksum)) FROM recovered_pairs WHERE path_checksum IS NOT NULL)",
    "q_mirror_delete": "WITH s AS (SELECT DISTINCT lang, lower(trim(path_checksum)) AS path FROM chunk_store WHERE trim(path_checksum) <> '') SELECT lang, path FROM s WHERE lang <> 'English' AND path NOT IN (SELECT path FROM s WHERE lang = 'English')",
    "q_vocab": f"SELECT {_VOCAB} AS terms",
    "q_prompt": f"""SELECT pair_id, sha256(replace(replace(replace(replace('Translate this [CONTENT_TYPE] from [SOURCE_LANGUAGE] into [TARGET_LANGUAGE]. Keep all markup. Terms:' || chr(10) || '[CUSTOM_VOCABULARY]', '[CONTENT_TYPE]', chunk_type), '[SOURCE_LANGUAGE]', src_lang), '[TARGET_LANGUAGE]', 'French'), '[CUSTOM_VOCABULARY]', {_VOCAB})
 || chr(10) || '<document>' || chr(10) || src_text || chr(10) || '</document>') AS sha FROM (SELECT DISTINCT pair_id, src_text, src_lang, chunk_type FROM recovered_pairs WHERE src_text IS NOT NULL)""",
    "q_response_extract": _REPLY + r""" SELECT pair_id, sha256(CASE WHEN contains(reply, '<output>') THEN array_to_string(regexp_extract_all(reply, '(?s)<output>\n?(.*?)(?:</output>|\z)', 1), '') ELSE array_to_string(regexp_extract_all(reply, '(?s)<document>.*?</document>'), '') END) AS sha FROM r""",
    "q_between_tags": _REPLY + f""", a AS (SELECT pair_id, strpos(reply, '<document>') AS i, substr(reply, strpos(reply, '<document>') + 10) AS rest FROM r)
SELECT pair_id, sha256(CASE WHEN i = 0 THEN '' WHEN strpos(rest, '</document>') = 0 THEN rest ELSE {_STRIP.format("substr(rest, 1, strpos(rest, '</document>') - 1)")} END) AS sha FROM a""",
    "q_prefix_lines": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(array_to_string(list_transform(x, lambda y: CASE WHEN regexp_full_match(y, '[ \t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]*') THEN y ELSE '> ' || y END), chr(10))) AS sha FROM l""",
    "q_byte_slice": "SELECT DISTINCT chunk_id, sha256(substr(content, 1, 40)) AS sha FROM typst_chunks WHERE content IS NOT NULL",
    "q_byte_slices": "WITH l AS (SELECT chunk_id, string_split(content, chr(10)) AS x FROM (SELECT DISTINCT chunk_id, content FROM typst_chunks WHERE content IS NOT NULL)) SELECT chunk_id, (generate_subscripts(x, 1) - 1)::BIGINT AS line, sha256(unnest(x)) AS sha FROM l",
    "q_languages": r"""WITH p AS (SELECT DISTINCT pair_id, tgt_lang FROM recovered_pairs), l AS (SELECT *, CASE lower(tgt_lang) WHEN 'english' THEN 'English' WHEN 'french' THEN 'French' WHEN 'german' THEN 'German' WHEN 'spanish' THEN 'Spanish' WHEN 'ukrainian' THEN 'Ukrainian' WHEN 'armenian' THEN 'Armenian' END AS lang FROM p)
SELECT lang, CASE lang WHEN 'English' THEN '_en' WHEN 'French' THEN '_fr' WHEN 'German' THEN '_de' WHEN 'Spanish' THEN '_es' WHEN 'Ukrainian' THEN '_ua' WHEN 'Armenian' THEN '_hy' END AS suffix, coalesce(regexp_full_match(tgt_lang, '[ \t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]*'), true) AS blank, count(*) AS n FROM l GROUP BY ALL""",
    "q_backoff": "SELECT range AS attempt, least(pow(2, range), 16)::BIGINT AS seconds FROM range(4)",
}
