"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored


#: Links that one task joins at most; 16 MB.
ONE_TASK = 1 << 20


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links, (node, root) of each node but the smallest of its component, which is the root."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = at[: len(left)], at[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _out(left, right):
    return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(left, right)], ["u", "v"])


def _local_forest(batches):
    """Each batch's links as stars around the smallest node of each of the batch's components."""
    for b in batches:
        if len(b):
            yield _out(b.column(0).to_numpy(), b.column(1).to_numpy())


def _whole_forest(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if parts:
        yield _out(*(np.concatenate(x) for x in zip(*parts)))


def connected_components(links: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of links(u, v), both long; root is the smallest node reachable.

    Large-star and small-star steps by turns, each a grouped minimum and a join, stored after each
    round; a chain of n links takes about log2(n) rounds. What is left of the links once each batch has joined its own
    is counted: `one_task` of them, a bound in bytes as well, are joined in one task, with the same result. Null ends and
    self-links are ignored; no links give no rows.
    """
    u, v = links.columns[:2]
    edges = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    edges = stored(edges.mapInArrow(_local_forest, "u long, v long"), "links")
    if edges.count() <= one_task:
        edges = stored(edges.coalesce(1).mapInArrow(_whole_forest, "u long, v long"), "links")
        return _roots(edges)
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stored(small, "links")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"links have not settled after {most_rounds} rounds")
    return _roots(edges)


def _roots(edges: DataFrame) -> DataFrame:
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
