"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bfd_packing, byte_bpe, conversation_repair, cost_packing, decontaminate, html_template, permutation_index, quality_cnn, simhash_dedup, spelling, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_packing.pack_matrices(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(_table(spark, sf_dir, "documents"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), every=31)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.summaries(rows, conversation_repair.repair(conversation_repair.damaged(rows)))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_html_extraction, op3_decontamination, op4_token_matrices, op5_packing, op6_permutation_index, op7_warc, op8_quality, op9_toxicity, op10_suffix_array_dedup, op11_spelling_variants, op12_byte_bpe, op13_conversation_repair)}
ORACLES = {"op3_decontamination": decontaminate.ORACLE, "op7_warc": warc.ORACLE}
