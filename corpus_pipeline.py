"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and gives what the next one works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrylake.llm import cost_packing, decontaminate, near_copies, suffix_dedup, toxicity
from sentrylake.llm._shared import stored


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of 5-word shingles at least 0.8; candidates by a wide
    SimHash, whose recall is in the README) the document of the smallest id stays."""
    return near_copies.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 400 bytes and more, that occur more than once go out of the texts."""
    return suffix_dedup.without_repeats(docs, words=suffix_dedup.WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; one row per piece."""
    return cost_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_dedup_filter),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has neither the classifier, the fingerprints, the suffix arrays nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
