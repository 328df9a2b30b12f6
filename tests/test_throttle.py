"""Limits, failure windows and as-of look-ups against plain loops."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from sentrylake.operators.asof import first_after, last_before
from sentrylake.streaming import throttle as T

ROWS = "id long, user string, at timestamp"


def replay(rows, window, limit):
    passed, out = {}, {}
    for i, user, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        kept = passed.setdefault(user, deque())
        while kept and kept[0] <= at - timedelta(seconds=window):
            kept.popleft()
        out[i] = len(kept) < limit
        if out[i]:
            kept.append(at)
    return out | {r[0]: False for r in rows if r[2] is None}


def requests(seed, n, steps, users="abc"):
    pick, now, out = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        now += timedelta(seconds=pick.choice(steps))
        out.append((i, pick.choice(users), now))
    return out


def test_a_refused_request_does_not_count(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "a", t + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 65, 70, 71))]
    got = {r.id: r.admitted for r in T.admissions(spark.createDataFrame(rows, ROWS), ["user"], "at", 60, 2, "id").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False} == replay(rows, 60, 2)


@pytest.mark.parametrize("steps, limit", [([0, 1, 2, 3], 3), ([0, 1, 5, 30, 200, 900], 2), ([1, 40], 1), ([1], 5)])
def test_decisions_equal_a_replay(spark, steps, limit):
    rows = requests(limit, 1500, steps, ["a", "a", "a", "b", None]) + [(9000, "a", None)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for windows in (2, 16):
        got = {r.id: r.admitted for r in T.admissions(df, ["user"], "at", 10, limit, "id", windows).collect()}
        assert got == replay(rows, 10, limit)
    assert set(replay(rows, 10, limit).values()) == {True, False}


def test_no_requests_and_clashing_names(spark):
    df = spark.createDataFrame([], ROWS)
    assert T.admissions(df, ["user"], "at", 10, 1, "id").collect() == []
    with pytest.raises(ValueError, match="clash"):
        T.admissions(df.withColumnRenamed("id", "_us"), ["user"], "at", 10, 1, "_us")


def test_decisions_of_a_stream(spark, tmp_path):
    rows = requests(4, 300, [1, 2, 9], "ab")
    df = spark.createDataFrame(rows, ROWS)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    T.admission_stream(stream, "user", "at", 10, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    want = replay(rows, 10, 2)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted((u, at, want[i]) for i, u, at in rows)


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_as_of(spark, bucket):
    pick = random.Random(bucket)
    rows = [(pick.choice("ab"), pick.randrange(-50, 300)) for _ in range(200)] + [(None, 5), ("c", 9)]
    marks = [(pick.choice("ab"), pick.randrange(-60, 310)) for _ in range(30)] + [(None, 5)]
    r, m = spark.createDataFrame(rows, "k string, at long"), spark.createDataFrame(marks, "k string, at long")
    before = lambda k, t: max((x for j, x in marks if j == k and k is not None and x <= t), default=None)
    after = lambda k, t: min((x for j, x in marks if j == k and k is not None and x >= t), default=None)
    order = lambda x: sorted(x, key=str)
    assert order(map(tuple, last_before(r, m, ["k"], "at", bucket, "found").where("k is not null").collect())) == order((k, t, before(k, t)) for k, t in rows if k is not None)
    assert order(map(tuple, first_after(r, m, ["k"], "at", bucket, "found").where("k is not null").collect())) == order((k, t, after(k, t)) for k, t in rows if k is not None)


def failures(rows, window, limit, block):
    state, out = {}, []
    for k, at in sorted(rows):
        count, begun, until = state.get(k, (0, None, None))
        if begun is None or at >= begun + timedelta(seconds=window):
            count, begun = 0, at
        count += 1
        if count >= limit:
            until = at + timedelta(seconds=block)
        state[k] = (count, begun, until)
        out.append((k, at, count, until is not None and at < until))
    return sorted(out)


@pytest.mark.parametrize("steps, block", [([0, 1, 5, 20], 30), ([0, 1], 200), ([50, 70, 300], 5)])
def test_failure_windows_of_one_hot_key(spark, steps, block):
    rows = [(u, at) for _, u, at in requests(block, 600, steps, "aaab")]
    got = T.failure_batch(spark.createDataFrame(rows, "user string, at timestamp").repartition(4), "user", "at", 60, 3, block)
    assert sorted(map(tuple, got.collect())) == failures(rows, 60, 3, block)
