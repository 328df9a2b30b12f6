"""A small made-up set to start an empty store with, and the checks that any such set has to pass."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://seed.example.org/")
TYPES = ["vulnerability", "advisory", "news", "report", "official_alert", "guide"]
SEVERITIES = ["critical", "high", "medium", "low", "none", "unknown"]
_SOURCES = ["seed-feed", "seed-advisories", "seed-news", "seed-guides"]
_ITEMS = [("vulnerability", n, "seed-feed") for n in range(4)] + [("advisory", n, "seed-advisories") for n in range(2)] + [("official_alert", 0, "seed-advisories"), ("news", 0, "seed-news"), ("report", 0, "seed-news"), ("guide", 0, "seed-guides")]


def dataset(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(sources, items): four sources and ten items; their ids follow from their keys."""
    sources = spark.createDataFrame([(str(uuid.uuid5(SPACE, s)), s, f"https://{s}.example.org/") for s in _SOURCES], "id string, slug string, base_url string")
    rows = []
    for place, (kind, n, source) in enumerate(_ITEMS):
        key = f"CVE-2099-90000{n + 1}" if kind == "vulnerability" else f"{kind}-{n + 1}"
        rows.append((str(uuid.uuid5(SPACE, key)), key, kind, f"Made-up {kind.replace('_', ' ')} {n + 1}", f"https://{source}.example.org/{key.lower()}", source, f"2099-01-{place + 1:02d} 00:00:00", SEVERITIES[n] if kind == "vulnerability" else None))
    items = spark.createDataFrame(rows, "id string, key string, item_type string, title string, url string, source string, published string, severity string")
    return sources, items.withColumn("published", F.col("published").cast("timestamp_ntz"))


def problems(sources: DataFrame, items: DataFrame) -> DataFrame:
    """(key, problem) of items(key, item_type, title, url, source, published, severity) against sources(slug): one row for
    each check that an item fails; keys of which there are several fail as repeated_key."""
    j = items.join(F.broadcast(sources.select(F.col("slug").alias("_slug")).distinct()), F.col("source") == F.col("_slug"), "left")
    vulnerability = F.col("item_type") == "vulnerability"
    checks = {
        "undefined_source": F.col("_slug").isNull(),
        "invalid_type": ~F.coalesce(F.col("item_type").isin(*TYPES), F.lit(False)),
        "invalid_title": ~F.coalesce(F.length(F.trim("title")).between(1, 500), F.lit(False)),
        "invalid_url": ~F.coalesce(F.col("url").rlike(r"^https://[^/\s@]+/\S*$"), F.lit(False)),
        "no_publication_time": F.col("published").isNull(),
        "invalid_severity": F.when(vulnerability, ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))).otherwise(False),
    }
    found = j.select("key", F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))).alias("problem"))
    repeated = items.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("repeated_key").alias("problem"))
    return found.unionByName(repeated)
