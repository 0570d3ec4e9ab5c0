"""Queries on chunking, segmentation and translation units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitile.functions.keys import content_checksum, is_blank
from lexitile.functions.text import BLOCKS, compile_cells, metadata_block, parse_metadata, py_strip, split_cells
from lexitile.operators import chunking as C
from lexitile.sources.tables import spread, table

LIMIT = 2000
#: Inline stretches of the SQL-expressible segmenter: math and code spans are placeholders.
INLINE = r"\$[^$\n]+\$|`[^`\n]+`|[^$`]+|[$`]"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_type").isin("markdown", "jupyter"), "myst").otherwise(F.col("doc_type"))
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text", kind.alias("kind")))


def q_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Segment, build the unit, reconstruct: the text must come back."""
    return _docs(spark, d).select("doc_id", content_checksum(C.reconstructed(C.units_of(F.col("text"), F.col("kind")))).alias("sha"))


def q_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of every document by type and kind."""
    s = _docs(spark, d).select("kind", F.explode(C.segments_of(F.col("text"), F.col("kind"))).alias("s"))
    return s.groupBy(F.col("kind").alias("chunk_type"), F.col("s.kind").alias("segment_kind")).agg(F.count("*").alias("n"), F.sum(F.length("s.content").cast("bigint")).alias("n_chars"))


def q_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of the recovered source chunks."""
    p = table(spark, d, "recovered_pairs").where("src_text is not null").select("pair_id", "src_text", "chunk_type").dropDuplicates(["pair_id"])
    u = p.select("pair_id", C.units_of(F.col("src_text"), F.col("chunk_type")).alias("u"))
    return u.select("pair_id", content_checksum(F.col("u.xml")).alias("xml_sha"), F.size("u.placeholders").cast("bigint").alias("n_placeholders"), F.col("u.ph_only").alias("ph_only"))


def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document by its own chunker."""
    return C.chunk_documents(_docs(spark, d), "doc_id", "text", "kind").select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.length("content").cast("bigint").alias("n_chars"), content_checksum(F.col("content")).alias("checksum"))


def q_typst_chunks_join(spark: SparkSession, d: str) -> DataFrame:
    """Typst chunks joined in order give the document."""
    c = C.chunk_documents(_docs(spark, d).where("kind = 'typst'"), "doc_id", "text", "kind")
    whole = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "").alias("t"))
    return whole.select("doc_id", content_checksum(F.col("t")).alias("sha"))


def _inline(spark: SparkSession, d: str) -> DataFrame:
    pieces = F.regexp_extract_all("text", F.lit(INLINE), F.lit(0))
    kind = lambda x: F.when(x.rlike(r"^(?:\$[^$]+\$|`[^`]+`)$"), "placeholder").otherwise("text")
    return _docs(spark, d).select("doc_id", F.transform(pieces, lambda x: F.struct(kind(x).alias("kind"), x.alias("content"))).alias("segments"))


def q_inline_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _inline(spark, d).select("doc_id", F.posexplode("segments").alias("pos", "s"))
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.kind").alias("kind"), content_checksum(F.col("s.content")).alias("sha"))


def q_coalesce(spark: SparkSession, d: str) -> DataFrame:
    s = _inline(spark, d).select("doc_id", F.posexplode(C.coalesced(F.col("segments"))).alias("pos", "s"))
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.kind").alias("kind"), content_checksum(F.col("s.content")).alias("sha"))


def q_ph_only(spark: SparkSession, d: str) -> DataFrame:
    u = _inline(spark, d).select("doc_id", C.built(F.col("segments")).alias("u"))
    return u.select("doc_id", "u.ph_only", "u.ph_only_blank")


def q_xml_unit(spark: SparkSession, d: str) -> DataFrame:
    return _inline(spark, d).select("doc_id", C.built(F.col("segments")).alias("u")).select("doc_id", content_checksum(F.col("u.xml")).alias("sha"))


def q_given_back(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents and recovered sources by type, and those a scanner does not give back whole."""
    docs = _docs(spark, d).select("kind", "text")
    pairs = table(spark, d, "recovered_pairs").where("src_text is not null").select("pair_id", F.col("chunk_type").alias("kind"), F.col("src_text").alias("text")).dropDuplicates(["pair_id"]).drop("pair_id")
    whole = docs.unionByName(pairs).select("kind", C.given_back(F.col("text"), F.col("kind")).alias("whole"))
    return whole.groupBy("kind").agg(F.count("*").alias("n_texts"), F.count_if(~F.col("whole")).alias("n_kept_whole"))


def q_chunks_cover(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every document in order, white space aside: nothing is lost, doubled or moved by any chunker."""
    c = C.chunk_documents(_docs(spark, d), "doc_id", "text", "kind")
    whole = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "").alias("t"))
    return whole.select("doc_id", content_checksum(F.regexp_replace("t", r"[\s\x1c-\x1f\x85\p{Z}]+", "")).alias("sha"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "typst_chunks").dropDuplicates(["chunk_id"]).where("path_checksum is not null")
    return p.select("chunk_id", "path_checksum", "lang", F.struct("ordinal", "chunk_id").alias("place"), "kind", F.coalesce("content", F.lit("")).alias("content"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return C.with_sections(_pieces(spark, d), ["path_checksum", "lang"], "place", F.col("content").startswith("="))


def q_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("chunk_id", F.col("section").cast("bigint").alias("section"))


def q_section_size_rule(spark: SparkSession, d: str) -> DataFrame:
    g = C.section_chunks(_sections(spark, d), ["path_checksum", "lang"], "place", LIMIT)
    return g.groupBy("path_checksum", "lang", "section", F.col("group_start.chunk_id").alias("first_chunk")).agg(F.count("*").alias("n_pieces"), F.sum(F.length("content").cast("bigint")).alias("n_chars")).withColumn("section", F.col("section").cast("bigint"))


def q_greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    s = _sections(spark, d).groupBy("path_checksum", "lang", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.length("content").cast("bigint").alias("n")))), lambda x: x["n"]).alias("sizes"))
    p = s.select("path_checksum", "lang", F.col("section").cast("bigint").alias("section"), F.posexplode(C.greedy_pack(F.col("sizes"), LIMIT)).alias("pack", "n_chars"))
    return p.withColumn("pack", F.col("pack").cast("bigint"))


def q_line_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = _docs(spark, d).where("text != ''").select("doc_id", F.posexplode(C.line_blocks(F.col("text"), 50)).alias("block", "content"))
    return b.select("doc_id", F.col("block").cast("bigint").alias("block"), content_checksum(F.col("content")).alias("sha"))


def q_chunk_checksum(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return b.select("doc_id", F.col("pos").cast("bigint").alias("pos"), content_checksum(F.col("line")).alias("sha"))


def q_gap_lines(spark: SparkSession, d: str) -> DataFrame:
    """Blank lines between a non-blank line and the next one; one pass over each document's own array."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("bigint").alias("pos"), is_blank(x).alias("blank"))), lambda x: ~x["blank"])
    gaps = lambda l: F.transform(l, lambda x, i: F.struct(x["pos"].alias("pos"), F.coalesce(F.get(l, i + 1)["pos"] - x["pos"] - 1, F.lit(-1).cast("bigint")).alias("gap")))  # noqa: E731, E741
    return _docs(spark, d).select("doc_id", F.explode(F.flatten(F.transform(F.array(lines), gaps))).alias("x")).select("doc_id", "x.pos", "x.gap")


def q_long_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "typst_chunks").where("content is not null").select("chunk_id", "content").dropDuplicates(["chunk_id"]).where(F.length("content") > 400)
    p = s.select("chunk_id", F.posexplode(C.split_long(F.col("content"), 400)).alias("piece", "c"))
    return p.select("chunk_id", F.col("piece").cast("bigint").alias("piece"), F.length("c").cast("bigint").alias("n_chars"))


def _cell_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "recovered_pairs").where("tgt_text is not null").select("pair_id", "chunk_type", "src_checksum", "tgt_text").dropDuplicates(["pair_id"])
    return p.select("pair_id", "chunk_type", F.trim(F.coalesce("src_checksum", F.lit(""))).alias("sum"), py_strip(F.col("tgt_text")).alias("source"))


def q_meta_parse(spark: SparkSession, d: str) -> DataFrame:
    """Metadata blocks written and parsed again, by chunk type."""
    meta = F.map_from_arrays(F.array(F.lit("src_checksum"), F.lit("needs_review")), F.array("sum", F.lit("True: yes")))
    out = None
    for kind in BLOCKS:
        m = parse_metadata(kind, metadata_block(kind, meta))
        rows = _cell_rows(spark, d).where(F.col("chunk_type") == kind).select("pair_id", m["src_checksum"].alias("src_checksum"), m["needs_review"].alias("needs_review"))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_compile(spark: SparkSession, d: str) -> DataFrame:
    """Target files: the cell with its block compiled, read back and split into cells again."""
    meta = F.map_from_arrays(F.array(F.lit("src_checksum")), F.array("sum"))
    out = None
    for kind in BLOCKS:
        text = compile_cells(kind, F.array(F.struct(meta.alias("meta"), F.col("source").alias("source")), F.struct(meta.alias("meta"), F.lit("end").alias("source"))))
        cells = split_cells(kind, text)
        rows = _cell_rows(spark, d).where(F.col("chunk_type") == kind).select("pair_id", content_checksum(text).alias("file_sha"), F.size(cells).cast("bigint").alias("n_cells"), content_checksum(cells[0]["source"]).alias("source_sha"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_KIND = "CASE WHEN doc_type IN ('markdown', 'jupyter') THEN 'myst' ELSE doc_type END"
_SEG = r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '\$[^$\n]+\$|`[^`\n]+`|[^$`]+|[$`]') AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::BIGINT AS pos, unnest(l) AS c FROM s),
g AS (SELECT *, CASE WHEN regexp_full_match(c, '\$[^$\n]+\$|`[^`\n]+`') THEN 'placeholder' ELSE 'text' END AS kind FROM e)"""
_CO = _SEG + """, h AS (SELECT *, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS fresh FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM h),
m AS (SELECT doc_id, (run - 1)::BIGINT AS pos, any_value(kind) AS kind, string_agg(c, '' ORDER BY pos) AS c FROM r GROUP BY doc_id, run)"""
_SEC = """WITH p AS (SELECT DISTINCT chunk_id, path_checksum, lang, ordinal, coalesce(content, '') AS content FROM typst_chunks WHERE path_checksum IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN starts_with(content, '=') THEN 1 ELSE 0 END) OVER (PARTITION BY path_checksum, lang ORDER BY ordinal, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM p)"""
_TRIM = r"regexp_replace(tgt_text, '^[ \t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+|[ \t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+$', '', 'g')"
_CELL = f"WITH c AS (SELECT DISTINCT pair_id, chunk_type, trim(coalesce(src_checksum, '')) AS sum, {_TRIM} AS source FROM recovered_pairs WHERE tgt_text IS NOT NULL)"
ORACLES = {
    "q_round_trip": "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL",
    "q_typst_chunks_join": "SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_type = 'typst' AND regexp_matches(text, '[^\\s\\p{Z}]')",
    "q_given_back": f"""SELECT kind, count(*) AS n_texts, 0::BIGINT AS n_kept_whole FROM (SELECT {_KIND} AS kind FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT kind FROM (SELECT DISTINCT pair_id, chunk_type AS kind FROM recovered_pairs WHERE src_text IS NOT NULL)) GROUP BY kind""",
    "q_chunks_cover": f"""SELECT doc_id, sha256(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+', '', 'g')) AS sha FROM documents
WHERE {_KIND} IN ('latex', 'myst', 'typst') AND regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]')""",
    "q_inline_segments": _SEG + " SELECT doc_id, pos, kind, sha256(c) AS sha FROM g",
    "q_coalesce": _CO + " SELECT doc_id, pos, kind, sha256(c) AS sha FROM m",
    "q_ph_only": _SEG + r" SELECT s.doc_id, coalesce(bool_and(kind <> 'text'), true) AS ph_only, coalesce(bool_and(kind <> 'text' OR regexp_full_match(c, '[ \t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]*')), true) AS ph_only_blank FROM s LEFT JOIN g USING (doc_id) GROUP BY s.doc_id",
    "q_xml_unit": _CO + """, n AS (SELECT *, count(*) FILTER (kind = 'placeholder') OVER (PARTITION BY doc_id ORDER BY pos) AS id,
 replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;') AS x FROM m)
SELECT s.doc_id, sha256('<document><TEXT>' || coalesce(string_agg(CASE WHEN kind = 'text' THEN x ELSE '<PH id="' || id || '">' || x || '</PH>' END, '' ORDER BY pos), '') || '</TEXT></document>') AS sha
FROM s LEFT JOIN n USING (doc_id) GROUP BY s.doc_id""",
    "q_sections": _SEC + " SELECT chunk_id, section FROM s",
    "q_section_size_rule": _SEC + """, t AS (SELECT *, sum(length(content)) OVER (PARTITION BY path_checksum, lang, section) AS total, first_value(chunk_id) OVER (PARTITION BY path_checksum, lang, section ORDER BY ordinal, chunk_id) AS f FROM s)
SELECT path_checksum, lang, section, CASE WHEN total > 2000 THEN chunk_id ELSE f END AS first_chunk, count(*) AS n_pieces, sum(length(content))::BIGINT AS n_chars FROM t GROUP BY ALL""",
    "q_greedy_pack": "WITH RECURSIVE " + _SEC[5:] + """, k AS (SELECT *, row_number() OVER (PARTITION BY path_checksum, lang, section ORDER BY ordinal, chunk_id) AS n FROM s),
f AS (SELECT path_checksum, lang, section, n, length(content)::BIGINT AS cur, 0::BIGINT AS pack FROM k WHERE n = 1
 UNION ALL SELECT k.path_checksum, k.lang, k.section, k.n, CASE WHEN f.cur > 0 AND f.cur + length(k.content) > 2000 THEN length(k.content) ELSE f.cur + length(k.content) END,
 CASE WHEN f.cur > 0 AND f.cur + length(k.content) > 2000 THEN f.pack + 1 ELSE f.pack END FROM f JOIN k ON k.path_checksum = f.path_checksum AND k.lang IS NOT DISTINCT FROM f.lang AND k.section = f.section AND k.n = f.n + 1)
SELECT path_checksum, lang, section, pack, max(cur) AS n_chars FROM f GROUP BY ALL HAVING max(cur) > 0""",
    "q_line_blocks": r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') AS x FROM documents WHERE text <> ''),
e AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS c FROM l) SELECT doc_id, (i // 50)::BIGINT AS block, sha256(string_agg(c, '' ORDER BY i)) AS sha FROM e GROUP BY ALL""",
    "q_chunk_checksum": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, (generate_subscripts(x, 1) - 1)::BIGINT AS pos, sha256(unnest(x)) AS sha FROM l",
    "q_gap_lines": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, (generate_subscripts(x, 1) - 1)::BIGINT AS pos, unnest(x) AS c FROM l) SELECT doc_id, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos - 1, -1) AS gap FROM e WHERE NOT regexp_full_match(c, '[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}]*')",
    "q_long_split": r"""WITH RECURSIVE t AS (SELECT DISTINCT chunk_id, content FROM typst_chunks WHERE length(content) > 400),
r AS (SELECT chunk_id, content AS rest, -1::BIGINT AS piece, 0::BIGINT AS n FROM t
 UNION ALL SELECT chunk_id, substr(rest, cut + 1), piece + 1, cut::BIGINT FROM (SELECT chunk_id, rest, piece,
  CASE WHEN length(rest) <= 400 THEN length(rest) ELSE (SELECT CASE WHEN w >= 240 THEN w ELSE 400 END FROM (SELECT 401 - position_ AS w FROM (SELECT length(regexp_extract(reverse(substr(rest, 1, 401)), '^[^ \t\n\r\x0B\f\x1C-\x1F\x{85}\p{Z}]*')) AS position_))) END AS cut FROM r WHERE rest <> ''))
SELECT chunk_id, piece, n AS n_chars FROM r WHERE piece >= 0""",
    "q_meta_parse": _CELL + " SELECT pair_id, sum AS src_checksum, 'True: yes' AS needs_review FROM c WHERE chunk_type IN ('latex', 'myst', 'typst')",
    "q_compile": _CELL + r""", f AS (SELECT pair_id, source, CASE chunk_type
 WHEN 'latex' THEN '% --- CHUNK_METADATA_START ---' || chr(10) || '% src_checksum: ' || sum || chr(10) || '% --- CHUNK_METADATA_END ---' || chr(10)
 WHEN 'myst' THEN chr(10) || '<!-- --- CHUNK_METADATA_START ---' || chr(10) || '% src_checksum: ' || sum || chr(10) || '--- CHUNK_METADATA_END --- -->' || chr(10)
 WHEN 'typst' THEN '// --- CHUNK_METADATA_START ---' || chr(10) || '// src_checksum: ' || sum || chr(10) || '// --- CHUNK_METADATA_END ---' || chr(10) END AS b, chunk_type FROM c WHERE chunk_type IN ('latex', 'myst', 'typst'))
SELECT pair_id, sha256(b || source || CASE WHEN chunk_type = 'typst' AND source <> '' THEN chr(10) ELSE '' END || b || 'end') AS file_sha, 2::BIGINT AS n_cells, sha256(source) AS source_sha FROM f""",
}
