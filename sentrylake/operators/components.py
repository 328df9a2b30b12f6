"""Connected components of links between whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Links that one task joins at most; 16 MB of memory.
ONE_TASK = 1 << 20


def _stars(parts):
    """The links of each part as stars around the least node of each of its components."""
    for u, v in parts:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = np.split(at, 2)
        root = np.arange(len(nodes))
        while True:
            least = root.copy()
            np.minimum.at(least, root[a], root[b])
            np.minimum.at(least, root[b], root[a])
            while (least != least[least]).any():
                least = least[least]
            if (least == root).all():
                break
            root = least
        leaf = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], ["u", "v"])


def _columns(batches):
    return ((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b))


def _each(batches):
    return _stars(_columns(batches))


def _all(batches):
    if parts := list(_columns(batches)):
        yield from _stars([tuple(np.concatenate(x) for x in zip(*parts))])


def components(links: DataFrame, one_task: int = ONE_TASK, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links(u, v), both long; root is the least node that it is joined to. Links with a null
    end and those of a node with itself are left out.

    Each Arrow batch joins its own links first. Up to `one_task` links that are left, counted, are joined in one task;
    more by rounds in which each node's greater neighbours, and then its smaller ones, are hung on the least of all."""
    u, v = links.columns
    edges = stored(links.selectExpr(f"cast(`{u}` as long) u", f"cast(`{v}` as long) v").where("u is not null and v is not null and u <> v").mapInArrow(_each, "u long, v long"), "links")
    if edges.count() <= one_task:
        edges = edges.coalesce(1).mapInArrow(_all, "u long, v long")
    else:
        seen = None
        for _ in range(most_rounds):
            both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            hung = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
            down = hung.selectExpr("greatest(u, v) as u", "least(u, v) as v")
            lowest = down.groupBy("u").agg(F.min("v").alias("m"))
            edges = stored(down.join(lowest, "u").selectExpr("inline(array(struct(v as u, m as v), struct(u as u, m as v)))").where("u <> v").distinct(), "links")
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"links have not settled after {most_rounds} rounds")
    leaves = stored(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "roots")
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
