"""The source registry: a small dimension that every session builds from a constant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "slug string, vendor string, source_type string, base_url string, enabled boolean, implemented boolean, needs_credentials boolean"
_ROWS = [
    ("vulnerability-feed", "public", "api", "https://feeds.example.org/vulnerabilities", True, True, False),
    ("score-feed", "public", "csv", "https://feeds.example.org/scores", True, True, False),
    ("exploited-catalog", "public", "json", "https://feeds.example.org/exploited", True, True, False),
    ("advisories", "cert", "rss", "https://cert.example.org/advisories", True, True, False),
    ("alerts", "cert", "rss", "https://cert.example.org/alerts", True, False, False),
    ("research", "vendor", "html", "https://vendor.example.com/research", False, True, True),
    ("knowledge", "public", "json", "https://taxii.example.org/collections", True, True, True),
]


def registry(spark: SparkSession, rows: list[tuple] = _ROWS) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def lookup(sources: DataFrame, slug: str) -> DataFrame:
    return sources.where(F.col("slug") == slug)


def usable(sources: DataFrame, vendor: str | None = None) -> DataFrame:
    out = sources.where("enabled and implemented")
    return out if vendor is None else out.where(F.col("vendor") == vendor)


def bootstrap(sources: DataFrame, catalog: DataFrame, legacy: dict[str, str] | None = None) -> DataFrame:
    """The registry against a stored catalog(slug, base_url): insert, unchanged, move (from a known old address),
    conflict, or unregistered."""
    old = F.lit(None).cast("string")
    for slug, url in (legacy or {}).items():
        old = F.when(F.col("slug") == slug, url).otherwise(old)
    j = sources.select("slug", F.col("base_url").alias("_want")).join(catalog.select("slug", F.col("base_url").alias("_have")), "slug", "full")
    return j.select("slug", F.when(F.col("_have").isNull(), "insert").when(F.col("_want").isNull(), "unregistered").when(F.col("_have") == F.col("_want"), "unchanged").when(F.col("_have") == old, "move").otherwise("conflict").alias("outcome"))


def load_if_empty(tables: list[DataFrame], snapshot: DataFrame) -> DataFrame:
    """The snapshot's rows if all tables are empty, else none."""
    return snapshot if all(t.isEmpty() for t in tables) else snapshot.limit(0)
