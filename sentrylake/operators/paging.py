"""Orders, pages, keyset rotation and bounded plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orders(name: str, created="created", published="published", key="id") -> list[Column]:
    """The three orders of item lists; every one ends with the key."""
    return {
        "recently_ingested": [F.desc(created), F.desc(key)],
        "newest_published": [F.desc_nulls_last(published), F.desc(key)],
        "oldest_published": [F.asc_nulls_last(published), F.asc(key)],
    }[name]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 100, farthest: int = 10_000) -> DataFrame:
    """One page; planned as a bounded top-k, never as a whole sort."""
    if not 1 <= limit <= most or not 0 <= offset <= farthest:
        raise ValueError(f"a limit of 1 to {most} and an offset of 0 to {farthest} are needed")
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next rows after a cursor, going on from the smallest key once the largest is reached. Column
    `wrapped` tells rows of the second turn."""
    k = F.col(key)
    return df.withColumn("wrapped", k <= after).orderBy(k <= after, k).limit(limit)


def next_cursor(batch: DataFrame, key: str) -> DataFrame:
    """One row: the last key of the batch, 0 if it wrapped."""
    last = F.max_by(F.struct(F.col(key).alias("key"), "wrapped"), F.struct("wrapped", F.col(key)))
    return batch.agg(last.alias("l")).select(F.when(F.col("l.wrapped"), 0).otherwise(F.col("l.key")).alias("cursor"))


def tiered(df: DataFrame, tier: Column, order: list[Column], limit: int) -> DataFrame:
    """Rows of the lowest tier first, then in order, up to the limit."""
    return df.withColumn("tier", tier).orderBy("tier", *order).limit(limit)


def bounded_plan(parts: dict[str, tuple[DataFrame, str]], limit: int) -> DataFrame:
    """(category, id) of several tables, each cut to limit + 1, ordered, cut to limit, with a truncation flag."""
    branches = [df.select(F.lit(name).alias("category"), F.col(key).cast("string").alias("id")).orderBy("id").limit(limit + 1) for name, (df, key) in parts.items()]
    union = branches[0]
    for b in branches[1:]:
        union = union.unionByName(b)
    top = union.orderBy("category", "id").limit(limit + 1)
    over = top.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return top.orderBy("category", "id").limit(limit).join(F.broadcast(over))  # one row is broadcast


def fair_candidates(df: DataFrame, last_scored: str, key: str, limit: int = 500) -> DataFrame:
    """Never scored first, then those scored longest ago."""
    return df.orderBy(F.asc_nulls_first(last_scored), F.asc(key)).limit(limit)
