import random

from pyspark.sql import functions as F

from sentrylake.llm import permutation_index as pi


def test_each_query_row_has_its_own_ranking(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    other = [r.gauss(0, 1) for _ in range(8)]
    rows += [rows[20], (40, other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in pi.neighbours(df, F.col("id") % 20 == 0, k=10, shard_rows=16).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))

    def want(i, q):
        near = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)
        return [(n + 1, j) for n, (_, j) in enumerate(near[:10])]

    assert sorted(got[20]) == sorted(2 * want(20, rows[20][1]))
    assert sorted(got[40]) == sorted(want(40, rows[40][1]) + want(40, other))
    assert sorted(got[0]) == want(0, rows[0][1])


def test_ties_and_a_very_common_id_across_shards(spark):
    """A third of the rows share an id and a vector; equal scores from several shards are ordered by id."""
    r = random.Random(4)
    shared = [1.0, 0.5, 0.0, 0.0]
    rows = [(7, shared)] * 40 + [(100 + i, shared) for i in range(30)] + [(200 + i, [r.uniform(-1, 0.4) for _ in range(4)]) for i in range(50)] + [(20, [1.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = sorted((x.rank, x.vec_id, x.score) for x in pi.neighbours(df, F.col("id") == 20, k=60, shard_rows=16).collect())
    assert [(n, i) for n, i, _ in out] == [(n + 1, i) for n, i in enumerate([7] * 40 + list(range(100, 120)))] and {s for *_, s in out} == {1.5}
