"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitile.llm.alignment import align_files
from lexitile.llm.encoding import garbled_documents, restore_documents
from lexitile.llm.langid import LanguageModel, fit, reference_rows, segment_languages, source_rows
from lexitile.llm.packing import pack
from lexitile.llm.pairs import pair_defects
from lexitile.llm.refusals import fit_refusals
from lexitile.llm.splitting import split_items
from lexitile.llm.texts import prose_sentences
from lexitile.llm.tokenizer import DEFAULT_RANKS, encode_corpus
from lexitile.sources.tables import table


#: Limits that hold where size_limits has no row of the kind.
DEFAULT_LIMITS = {"typst_chunk": (2000, 120), "document": (2048, 0)}


def limits(spark: SparkSession, sf_dir: str, kind: str) -> tuple[int, int]:
    """``max_size, overlap_size`` of an item kind; size_limits has one row a kind."""
    r = table(spark, sf_dir, "size_limits").where((F.col("item_kind") == kind) & F.col("max_size").isNotNull()).select("max_size", F.coalesce("overlap_size", F.lit(0))).first()
    return (int(r[0]), int(r[1])) if r else DEFAULT_LIMITS[kind]


def labelled(spark: SparkSession, sf_dir: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The reference texts and a bounded sample of source texts, whose language is reliable, as ``(language, text)``."""
    samples = table(spark, sf_dir, "lang_samples").select("lang", F.col("sample_text").alias("text"))
    sources = table(spark, sf_dir, "recovered_pairs").select(F.col("src_lang").alias("lang"), F.col("src_text").alias("text"))
    return reference_rows(samples), source_rows(sources)


def language_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    samples, sources = labelled(spark, sf_dir)
    return fit(samples + sources)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment_languages(table(spark, sf_dir, "recovered_pairs"), language_model(spark, sf_dir), "pair_id", "tgt_text", "tgt_lang", only_doubtful=True)
    return found.select("pair_id", "seg_no", "lang")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every text and stretch."""
    return segment_languages(table(spark, sf_dir, "recovered_pairs"), language_model(spark, sf_dir), "pair_id", "tgt_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, sources = labelled(spark, sf_dir)
    refusals = fit_refusals([(lang, s) for lang, text in sources for s in prose_sentences(text)])
    return pair_defects(table(spark, sf_dir, "recovered_pairs"), fit(samples + sources), refusals, "pair_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "typst_chunks"), "chunk_id", "content", *limits(spark, sf_dir, "typst_chunk"), range_col="byte_range")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 0").select("chunk_id", F.col("item_cut").alias("cut"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_files(table(spark, sf_dir, "file_pairs"), "file_pair_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), ranks_path=DEFAULT_RANKS)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = encode_corpus(table(spark, sf_dir, "documents"), count_only=True)
    return pack(sizes, "doc_id", "n_tokens", limits(spark, sf_dir, "document")[0])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_pieces, p3_found, p4_found, p6_ids, p7_containers, p8_found, p8_restored)}

ORACLES = {
    "p2_found": r"""
SELECT chunk_id, CASE WHEN regexp_matches(content, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]{1000}[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]{1000}[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]') THEN 'forced' ELSE 'natural' END AS cut
FROM (SELECT DISTINCT chunk_id, content FROM typst_chunks WHERE length(content) > 2000)
""",
}
