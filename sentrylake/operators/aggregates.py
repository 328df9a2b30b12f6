"""Counts, histograms, time lines and status ladders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import ARTICLE_TYPES, instant


def dashboard_counts(items: DataFrame, start: datetime, end: datetime, score: float = 0.7) -> DataFrame:
    """All dashboard counts in one pass over the items."""
    on, vulnerable = F.col("status") == "active", F.col("item_type") == "vulnerability"
    vuln = on & vulnerable
    return items.agg(
        F.count_if(on).alias("active_items"),
        F.count_if(on & F.col("item_type").isin(*ARTICLE_TYPES)).alias("active_articles"),
        F.count_if(vuln & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(vuln & (F.col("severity") == "high")).alias("high"),
        F.count_if(vuln & (F.col("kev_status") == "listed")).alias("listed"),
        F.count_if(vuln & (F.col("epss") >= F.lit(score).cast("decimal(7,6)"))).alias("likely_exploited"),
        F.count_if(on & F.col("relevance").isin("confirmed", "probable")).alias("relevant"),
        F.count_if(on & (F.col("collected") >= instant(start)) & (F.col("collected") < instant(end))).alias("collected_in_window"),
    )


def status_map(df: DataFrame, status: str) -> DataFrame:
    """One row with the map of statuses to counts."""
    counts = df.groupBy(F.col(status).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("counts"))


def zero_filled(df: DataFrame, column: str, values: list[str], missing: str) -> DataFrame:
    """Counts of the given values, 0 where there are none; nulls count as `missing`."""
    spark = df.sparkSession
    dimension = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, place int")
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return dimension.join(counts, dimension[column] == counts["_k"], "left").select(column, "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def daily_timeline(first: DataFrame, second: DataFrame, at: str, days: int = 7) -> DataFrame:
    """Counts of two series for each of the newest days with any row, oldest first."""
    both = first.select(F.col(at).alias("at"), F.lit(1).alias("s")).unionByName(second.select(F.col(at).alias("at"), F.lit(2).alias("s")))
    per = both.where("at is not null").groupBy(F.to_date("at").alias("day")).agg(F.count_if(F.col("s") == 1).alias("first"), F.count_if(F.col("s") == 2).alias("second"))
    return per.orderBy(F.desc("day")).limit(days).orderBy("day")


def grouped_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Parents with the number of rows that each named table has for them, 0 if none."""
    for name, (rows, parent_key) in children.items():
        n = rows.groupBy(F.col(parent_key).alias("_k")).agg(F.count(F.lit(1)).alias(name))
        parents = parents.join(n, parents[key] == n["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return parents


def cycle_rollup(runs: DataFrame, cycle: str, status: str, done: list[str], good: list[str]) -> DataFrame:
    """Counters of each cycle and the status that they give."""
    s = F.col(status)
    n = runs.groupBy(cycle).agg(F.count(F.lit(1)).alias("started"), F.count_if(s.isin(*done)).alias("completed"), F.count_if(s.isin(*good)).alias("successful"))
    n = n.withColumn("unsuccessful", F.col("completed") - F.col("successful"))
    return n.withColumn(
        "cycle_status",
        F.when(F.col("completed") < F.col("started"), "running").when(F.col("unsuccessful") == 0, "success").when(F.col("successful") > 0, "partial").otherwise("failed"),
    )


def outcome_counters(df: DataFrame, group: list[str], outcome: str, outcomes: list[str]) -> DataFrame:
    """A counter for each outcome, and the status of the whole: any failed or skipped row makes it partial."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes))
    return n


def run_status(created: Column, updated: Column, skipped: Column, failed: Column, total: Column) -> Column:
    return (
        F.when((failed == total) & (total > 0), "failed")
        .when(failed + skipped > 0, "partial")
        .when(created + updated == 0, "no_change")
        .otherwise("success")
    )


def storage_level(used: Column, limit: Column, warn: float = 0.85, full: float = 0.95) -> Column:
    ratio = used / limit
    return F.when(ratio >= full, "critical").when(ratio >= warn, "warning").otherwise("healthy")


def worst(df: DataFrame, level: str, order: list[str]) -> DataFrame:
    """The worst level of all rows, by the order from best to worst."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(level))
    return df.agg(F.max_by(level, rank).alias("overall"))


def percentile_by_index(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """The element at place int((n - 1) * share) of each group's sorted values; no interpolation.

    Spark's percentile interpolates, so the place is looked up in a count of distinct values."""
    from pyspark.sql import Window

    n = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("_to", upto).withColumn("_all", F.sum("_c").over(w)).withColumn("_at", F.floor((F.col("_all") - 1) * share))
    return n.where((F.col("_to") > F.col("_at")) & (F.col("_to") - F.col("_c") <= F.col("_at"))).select(*group, F.col(value).alias("value"))
