"""Top rows of groups: alias and child caps, latest rows, curated quotas, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import pick_one


def first_in_group(df: DataFrame, group: list[str], order: list[Column | str], most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each group; the planner limits each map task's groups too."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= most)


#: Fixed: how many children of each kind a detail view shows.
DETAIL_CAPS = {"source_records": 25, "import_runs": 20, "indicators": 100, "tags": 16, "provenances": 50, "relationships": 100}


def detail_lists(children: dict[str, DataFrame], caps: dict[str, int] = DETAIL_CAPS) -> DataFrame:
    """(kind, parent, child, rank): of each parent's children(parent, child, at) of each kind the newest, at most the kind's
    cap, ties by child. Each kind is limited on the map side."""
    parts = [first_in_group(df.select("parent", "child", "at"), ["parent"], [F.desc("at"), "child"], caps[kind]).select(F.lit(kind).alias("kind"), "parent", "child", "rank") for kind, df in children.items()]
    return reduce(DataFrame.unionByName, parts)


def latest(df: DataFrame, group: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each group; a map-side aggregate, so a group of any size is no burden."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_row")).select(*group, *(F.col("_row").getField(c).alias(c) for c in rest))


def preferred_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the listed one first, then the higher score, the later change, the smaller hash."""
    return pick_one(df, [key], [~F.col("listed"), -F.col("score"), -F.unix_micros(F.col("modified").cast("timestamp")), F.col("content_hash")])


#: Fixed quotas of the curated selection for each year.
QUOTAS = {"critical": 10, "high": 5, "medium": 3, "low": 2}


def curated(df: DataFrame, key: str = "id", quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """The quota of each year and severity, after duplicates: listed ones, higher scores, later changes first."""
    one = preferred_duplicates(df, key)
    quota = F.coalesce(*(F.when(F.col("severity") == s, n) for s, n in quotas.items()))
    ranked = first_in_group(one.where(F.col("severity").isin(*quotas)), ["year", "severity"], [~F.col("listed"), F.desc("score"), F.desc("modified"), key], max(quotas.values()))
    return ranked.where(F.col("rank") <= quota)


def latest_versions(objects: DataFrame) -> DataFrame:
    """The newest version of each object and whether its lineage holds: no two versions of one time, one type,
    one creation time and creator, and only the last one revoked."""
    n = objects.groupBy("id").agg(
        F.max_by(F.struct("modified", "type", "revoked", "payload"), F.struct("modified", "payload")).alias("last"),
        F.count(F.lit(1)).alias("versions"),
        F.count_distinct("modified").alias("times"),
        F.count_distinct("type").alias("types"),
        F.count_distinct(F.struct("created", "creator")).alias("origins"),
        F.max(F.when(F.col("revoked"), F.col("modified"))).alias("revoked_at"),
        F.min(F.when(F.col("revoked"), F.col("modified"))).alias("first_revoked"),
    )
    holds = (F.col("times") == F.col("versions")) & (F.col("types") == 1) & (F.col("origins") == 1) & (F.col("first_revoked").isNull() | (F.col("first_revoked") == F.col("last.modified")))
    return n.select("id", "last.modified", "last.type", "last.revoked", "last.payload", "versions", holds.alias("lineage_holds"))


def over_limit(sessions: DataFrame, user: str, issued: str, key: str, most: int) -> DataFrame:
    """The oldest active sessions that must go so that one more keeps within the limit."""
    w = Window.partitionBy(user)
    ranked = sessions.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_at", F.row_number().over(w.orderBy(issued, key)))
    return ranked.where(F.col("_at") <= F.col("_n") - most + 1).drop("_n", "_at")
