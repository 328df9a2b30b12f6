"""Unions, membership, reconciliation of sets, and deduplication with conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def membership(df: DataFrame, key: str, catalog: DataFrame, catalog_key: str, name: str = "catalog_status") -> DataFrame:
    """'listed' or 'not_listed' for each row; the catalog's keys are made distinct first."""
    keys = catalog.select(F.col(catalog_key).alias("_key")).distinct()
    return df.join(keys, df[key] == keys["_key"], "left").withColumn(name, F.when(F.col("_key").isNotNull(), "listed").otherwise("not_listed")).drop("_key")


def unanswered(requested: DataFrame, returned: DataFrame, invalid: DataFrame, key: str) -> DataFrame:
    """Requested keys that were neither returned nor found invalid."""
    known = returned.select(key).unionByName(invalid.select(key)).distinct()
    return requested.select(key).distinct().join(known, key, "left_anti")


def reconciled(existing: DataFrame, desired: DataFrame, keys: list[str], value: str, protected: Column | None = None) -> DataFrame:
    """Keys of either side with the action that makes existing equal to desired: create, update, unchanged,
    delete; `protected`, where existing rows satisfy it, for those that must stay."""
    e = existing.select(*keys, F.col(value).alias("_old"), (protected if protected is not None else F.lit(False)).alias("_kept"), F.lit(True).alias("_here"))
    d = desired.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_there"))
    action = (
        F.when(F.col("_here").isNull(), "create")
        .when(F.col("_kept"), "protected")
        .when(F.col("_there").isNull(), "delete")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("update")
    )
    return e.join(d, keys, "full").select(*keys, action.alias("action"))


def first_or_conflict(df: DataFrame, group: list[str], content: str, order: str) -> DataFrame:
    """One row per key: the first by order, the number of rows, and whether their contents differ."""
    return df.groupBy(*group).agg(F.min_by(content, order).alias(content), F.min(order).alias("first"), F.count(F.lit(1)).alias("members"), (F.min(content) != F.max(content)).alias("conflict"))


def without_conflicts(df: DataFrame, group: list[str], content: str) -> DataFrame:
    """Rows whose key has one content only; a conflict rejects all of the key's rows."""
    ok = df.groupBy(*group).agg(F.min(content).alias("_a"), F.max(content).alias("_b")).where(F.col("_a") == F.col("_b")).select(*group)
    return df.join(ok, group, "left_semi")


def matched_responses(requests: DataFrame, responses: DataFrame, key: str, content: str, valid: Column, omitted: str = "unchanged") -> DataFrame:
    """An outcome for each requested or returned key: matched, omitted, conflict, invalid or unknown."""
    r = responses.withColumn("_ok", valid).groupBy(key).agg(F.count_distinct(content).alias("_kinds"), F.min("_ok").alias("_valid"))
    q = requests.select(key).distinct().withColumn("_asked", F.lit(True))
    outcome = (
        F.when(F.col("_kinds").isNull(), omitted)
        .when(F.col("_asked").isNull(), "unknown")
        .when(~F.col("_valid"), "invalid")
        .when(F.col("_kinds") > 1, "conflict")
        .otherwise("matched")
    )
    return q.join(r, key, "full").select(key, outcome.alias("outcome"))


def ordered_unique(c: str) -> Column:
    return F.array_distinct(F.col(c))
