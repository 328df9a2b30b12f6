import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import permutation_index as pi


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = [(i, np.pad(v, (0, 8 - len(v)))) for i, v in ok]
    out = {}
    for q, v in ok:
        if q % every == 0:
            best = sorted(((-float(v @ w), i) for i, w in ok if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.standard_normal(8).astype(np.float32).tolist()) for i in range(60)]
    rows[7] = (7, rows[3][1])
    rows[9] = (9, rows[3][1])
    rows += [(100, None), (101, [0.0] * 8), (102, [1.0, None] + [0.0] * 6), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (105, [1.0, 2.0]), (None, rows[0][1])]
    got = {}
    for x in pi.neighbours(frame(spark, rows), F.col("id") % 20 == 0, k=5, shard_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, pytest.approx(x.score)))
    want = brute([(i, v) for i, v in rows], 5, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [a for a, _ in want[q]] == [a for a, _ in got[q]]
        assert [s for _, s in want[q]] == [s for _, s in got[q]]


def test_fewer_rows_than_asked(spark):
    out = pi.neighbours(frame(spark, [(0, [1.0] * 8), (1, [2.0] * 8)]), F.col("id") == 0).collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in out] == [(0, 1, 1, 16.0)]
    assert pi.neighbours(frame(spark, [(0, [0.0] * 8)]), F.col("id") == 0).count() == 0
    assert pi.neighbours(frame(spark, []), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered):
    """At least 0.9 of the true neighbours, on vectors without structure and on ones with a dense third."""
    r = np.random.default_rng(1)
    x = r.standard_normal((6000, 8 if clustered else 32))
    if clustered:
        x[::3] = x[0] + 0.02 * r.standard_normal(x[::3].shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hits = total = 0
    got = {}
    for row in pi.neighbours(df, F.col("id") % 100 == 0, k=20, shard_rows=2000, least=100).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    y = x.astype(float)
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -9
        hits += len(found & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
        total += 20
    assert len(got) == 60 and hits / total >= 0.9


def test_footrule_falls_with_shared_pivots():
    r = np.random.default_rng(2)
    x, p = r.standard_normal((200, 6)), r.standard_normal((20, 7))
    square = float((x * x).sum(1).max())
    shard = pi.Shard(np.arange(200), x, p, square, 7, 2.0)
    order = pi.orders(pi.lifted(x, square), p, 7)
    place = np.full((200, 20), 7)
    np.put_along_axis(place, order, np.arange(7)[None], axis=1)
    for q in (0, 17):
        foot = np.abs(place - place[q]).sum(1)
        assert set(shard.candidates(order[q], 30)) == set(np.lexsort((np.arange(200), foot))[:30])


@pytest.mark.parametrize("sigma", [0.0, 0.6, 1.0])
def test_recall_at_any_norms_with_defaults(spark, sigma):
    """At least 0.9 of the largest inner products, for norms that are alike and for norms that differ a hundredfold."""
    r = np.random.default_rng(7)
    x = r.standard_normal((10_000, 32))
    x *= (np.exp(sigma * r.standard_normal(len(x))) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for row in pi.neighbours(df, F.col("id") % 20 == 0).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    assert len(got) == 500
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
