"""Join shapes: top-1 picks, semi and existence joins, graph neighbours, newest attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_one(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """One row of each group, the first by `order`, which must be total; nulls come first.

    The planner limits each map task's groups to a row before the shuffle, so a group of any size sends one row per
    task, and columns that nobody asks for are never read."""
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_first", first).where(F.col("_first") == 1).drop("_first")


def primary_record(records: DataFrame) -> DataFrame:
    """Of an item's records the primary one, else the first by source, external id, url and time."""
    order = [~F.col("is_primary"), F.coalesce("source", F.lit("")), F.coalesce("external_id", F.lit("")), F.col("url"), F.col("seen"), F.col("record_id")]
    return pick_one(records, ["item_id"], order)


def primary_by_creation(records: DataFrame) -> DataFrame:
    """The variant for scope lists: primary first, then source, time and id."""
    return pick_one(records, ["item_id"], [~F.col("is_primary"), F.col("source"), F.col("seen"), F.col("record_id")])


def primary_identifier(identifiers: DataFrame) -> DataFrame:
    """The primary identifier, else one of namespace cve; items with neither are left out."""
    usable = identifiers.where(F.col("is_primary") | (F.col("namespace") == "cve"))
    return pick_one(usable, ["item_id"], [~F.col("is_primary"), F.col("value")])


def having(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows with a partner, each once."""
    o = other.select(F.col(other_key).alias("_key"))
    return df.join(o, df[key] == o["_key"], "left_semi")


def lacking(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    o = other.select(F.col(other_key).alias("_key"))
    return df.join(o, df[key] == o["_key"], "left_anti")


def flagged(df: DataFrame, key: str, **others: tuple[DataFrame, str]) -> DataFrame:
    """A boolean column for each named table: whether it has the row's key."""
    for name, (other, other_key) in others.items():
        keys = other.select(F.col(other_key).alias(f"_{name}")).distinct()
        df = df.join(keys, df[key] == keys[f"_{name}"], "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return df


def neighbours(nodes: DataFrame, edges: DataFrame, key: str = "id", source: str = "source", target: str = "target") -> DataFrame:
    """(id, other, direction) of the edges at each node; a self-edge is outgoing only.

    Two equi-joins and a union, where a join on either end at once would be a nested loop."""
    ids = nodes.select(F.col(key).alias("id"))
    out = ids.join(edges, ids["id"] == edges[source]).select("id", F.col(target).alias("other"), F.lit("outgoing").alias("direction"))
    back = edges.where(F.col(source) != F.col(target))
    inward = ids.join(back, ids["id"] == back[target]).select("id", F.col(source).alias("other"), F.lit("incoming").alias("direction"))
    return out.unionByName(inward)


def newest_attempts(runs: DataFrame, group: list[str], attempt: str = "attempt") -> DataFrame:
    """Rows of each group's highest attempt, all of them if several tie."""
    best = runs.groupBy(*group).agg(F.max(attempt).alias("_best"))
    return runs.join(best, group).where(F.col(attempt) == F.col("_best")).drop("_best")


def children(parents: DataFrame, key: str, rows: DataFrame, parent_key: str, columns: list[str], order: list[str], name: str, most: int) -> DataFrame:
    """Parents with at most `most` of their children as an array of structs; the cap comes before the gathering."""
    first = Window.partitionBy(parent_key).orderBy(*order)
    some = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    lists = some.groupBy(F.col(parent_key).alias("_parent")).agg(F.sort_array(F.collect_list(F.struct("_n", *columns))).alias(name))
    lists = lists.withColumn(name, F.transform(name, lambda x: F.struct(*(x[c].alias(c) for c in columns))))
    return parents.join(lists, parents[key] == lists["_parent"], "left").drop("_parent")
