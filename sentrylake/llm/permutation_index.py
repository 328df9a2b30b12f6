"""Approximate nearest neighbours by largest inner product, with a permutation index.

Inner products are no metric, so vectors first get one more component, sqrt(M^2 - |x|^2) with M the largest norm of
the table, and queries a zero there: all vectors then have the norm M, and the angle to a query grows as the inner
product falls, whatever the norms are.

Every vector is represented by its `prefix` nearest of `pivots` pivot vectors, in order. Vectors are
dealt to shards by their id; a shard posts its vectors in one inverted file
for each pivot, as (row, place of the pivot). A query goes through the files of its own pivots and
ranks the shard's rows by footrule distance of the two orders (a missing pivot counts as at place
`prefix`); the `share` of rows that come first are reranked by the exact inner product. The best `k` of
each shard meet in the end.

The pivots are chosen, far from each other, out of a sample of 8 rows for each; every row is indexed.
Queries travel to every shard by the shard's number, so neither vectors nor queries pass through the
driver. The stated queries meet all rows in blocks, so work grows with queries times rows, at a small constant: vectors
without structure leave no index anything to leave out, and the `share` is what keeps recall above 0.9 there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

_OUT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with one more component, so that the square of each one's norm is `square`."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, square - (x * x).sum(axis=1)))[:, None]], axis=1)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each row, nearest first; pivots have one norm, ties go to the earlier one. Rows
    without the last component, as queries, have a zero there."""
    return np.argsort(-(x @ pivots[:, : x.shape[1]].T), axis=1, kind="stable")[:, :prefix]


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample of one norm, each the one whose nearest chosen row is farthest; a cluster gives few of them."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


class Shard:
    """One shard's inverted files; ids ascend, so that equal distances favour smaller ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, square: float, prefix: int, close: float):
        at = np.argsort(ids, kind="stable")
        self.ids, self.x, self.prefix, self.close = ids[at], x[at], prefix, close
        order = orders(lifted(self.x, square), pivots, prefix)
        row = np.repeat(np.arange(len(order)), order.shape[1])
        place = np.tile(np.arange(order.shape[1]), len(order))
        by = np.argsort(order.ravel(), kind="stable")
        cuts = np.searchsorted(order.ravel()[by], np.arange(len(pivots) + 1))
        self.files = [(row[by[a:b]], place[by[a:b]].astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:])]

    def candidates(self, order: np.ndarray, n: int) -> np.ndarray:
        """The n rows of least footrule distance, and all whose distance is within 1 - close of the largest: the
        order cannot tell the members of a dense cluster apart, so none of them is left out. The distance of two orders of `prefix` pivots falls by
        2 * (prefix - larger place) with each pivot that they share."""
        if n >= len(self.ids):
            return np.arange(len(self.ids))
        gain = np.zeros(len(self.ids), np.int64)
        for place, pivot in enumerate(order):
            rows, places = self.files[pivot]
            gain[rows] += self.prefix - np.maximum(places, place)
        key = gain * len(self.ids) - np.arange(len(self.ids))
        first = np.argpartition(-key, n - 1)[:n]
        near = np.flatnonzero(gain >= self.close * (self.prefix * (self.prefix + 1) // 2))
        return np.union1d(first, near) if len(near) else first

    def best(self, query_id: int, q: np.ndarray, order: np.ndarray, n: int, k: int):
        at = self.candidates(order, n)
        at = at[self.ids[at] != query_id]
        score = self.x[at] @ q
        if len(at) > k:
            edge = np.partition(score, len(at) - k)[len(at) - k]
            keep = score >= edge
            at, score = at[keep], score[keep]
        by = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[by]], score[by]


def _search(held, prefix: int, share: float, close: float, least: int, k: int):
    def run(batches):
        pivots, square = held.value
        dim = pivots.shape[1] - 1
        shard_no, parts, shard = None, [], None

        def made():
            return Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pivots, square, prefix, close) if parts else None

        for b in batches:
            no, kind, ids, keys = (b.column(c).to_numpy() for c in ("shard", "kind", "id", "query"))
            cut = np.flatnonzero((np.diff(no) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip(np.append(0, cut), np.append(cut, len(no))):
                if i == j:
                    continue
                if no[i] != shard_no:
                    shard_no, parts, shard = no[i], [], None
                x = _rows(b.column("v").slice(i, j - i), dim)
                if kind[i] == 0:
                    parts.append((ids[i:j], x))
                    continue
                if shard is None:
                    shard = made()
                    parts = []
                if shard is None:
                    continue
                n = max(least, int(np.ceil(share * len(shard.ids))))
                out = [(q, *shard.best(q, v, o, n, k), key) for q, v, o, key in zip(ids[i:j], x, orders(x, pivots, prefix), keys[i:j])]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat([o[f] for o in out], [len(o[1]) for o in out]).astype(np.int64)) for f in (3, 0)), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))], schema=_OUT)

    return run


def valid(vectors: DataFrame) -> DataFrame:
    """(id, v) of the rows that take part: with an id, and a vector without null or non-finite components that is
    not all zero."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 128, prefix: int = 32, share: float = 0.35, close: float = 0.6, least: int = 512, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query (a condition on `id`, the vec_id) the k nearest rows found but
    its own, nearest first, ties to the smaller vec_id; all others if there are fewer.

    Rows that take no part: see `valid`. A vector shorter than the table's longest has zeros for what it lacks. Each
    query row has a ranking of its own: where rows of queries repeat an id, query_id and rank repeat, one ranking for
    each row. Rows with the query's id are its own; of other rows that repeat an id each is found for itself. Other
    columns are ignored; no queries or no vectors give no rows. Shards have `shard_rows` rows, and as many as eight
    times that once there are more than 64, since every query travels to every shard.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    n, dim, square = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    sampled = rows.orderBy(F.xxhash64("id"), "id", "v").limit(8 * pivots).collect()
    chosen = spread(lifted(np.array([r.v for r in sampled], np.float64), square), pivots)
    held = spark.sparkContext.broadcast((chosen, square))
    shards = max(min(64, -(-n // shard_rows)), -(-n // (8 * shard_rows)))
    # by the row as well as its id, so that an id of very many rows has them in all shards
    base = rows.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("long").alias("shard"), F.lit(0).alias("kind"), "id", "v", F.lit(0).cast("long").alias("query"))
    # stored, so that a row has one number in all shards
    asked = stored(rows.where(is_query).withColumn("query", F.monotonically_increasing_id()), "queries")
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "id", "v", "query")
    met = base.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(_search(held, min(prefix, len(chosen)), share, close, least, k), "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
