import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sentrylake.sources.feeds import json_state, score_batches
from sentrylake.sources.sinks import write_csv
from sentrylake.streaming import progress as G
from sentrylake.streaming import throttle as T


def failures(n=120):
    r, now, out = random.Random(3), datetime(2024, 1, 1), []
    for _ in range(n):
        now += timedelta(seconds=r.choice([1, 5, 20, 90]))
        out.append((r.choice("ab"), now))
    return out


def replay(rows, window, limit, block):
    state, out = {}, []
    for k, at in sorted(rows, key=lambda x: (x[0], x[1])):
        count, begun, until = state.get(k, (0, datetime.min, datetime.min))
        if at >= begun + timedelta(seconds=window) if begun != datetime.min else True:
            count, begun = 0, at
        count += 1
        if count >= limit:
            until = at + timedelta(seconds=block)
        state[k] = (count, begun, until)
        out.append((k, at, count, at < until))
    return sorted(out)


def test_failure_windows_in_batch_and_stream(spark, tmp_path):
    rows = failures()
    df = spark.createDataFrame(rows, "user string, at timestamp")
    want = replay(rows, 60, 3, 30)
    assert sorted(map(tuple, T.failure_batch(df, "user", "at", 60, 3, 30).collect())) == want
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = T.failure_stream(stream, "user", "at", 60, 3, 30).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_sliding_counts(spark):
    rows = failures(80)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, user string, at timestamp")
    got = {r.id: r.recent for r in T.recent(df, ["user"], "at", 60, "id").collect()}
    for i, (k, at) in enumerate(rows):
        assert got[i] == sum(1 for u, x in rows if u == k and at - timedelta(seconds=60) < x <= at)


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    written = []
    run = G.once(lambda df, n: written.append((n, df.count())), f"{tmp_path}/log")
    df = spark.range(3)
    for n in (0, 0, 1, 0, 1):
        run(df, n)
    assert written == [(0, 3), (1, 3)]


def test_stream_drops_repeated_versions(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    now = datetime(2024, 1, 1)
    spark.createDataFrame([("a", "h1", now), ("a", "h1", now), ("a", "h2", now)], "id string, h string, modified timestamp").write.parquet(src)
    stream = spark.readStream.schema("id string, h string, modified timestamp").parquet(src)
    q = G.deduplicated_stream(stream, "modified", ["id", "h"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.id, r.h) for r in spark.read.parquet(out).collect()) == [("a", "h1"), ("a", "h2")]


def test_watermark_goes_on_only_after_success(spark):
    slot, old = F.lit("2024-02-01"), F.lit("2024-01-01")
    step = lambda *s: G.next_watermark(spark.createDataFrame([(x,) for x in s], "s string"), "s", slot, old).first().watermark
    assert step("success", "no_change") == "2024-02-01" and step("success", "partial") == "2024-01-01"


def test_csv_sink(spark, tmp_path):
    write_csv(spark.createDataFrame([("'=1", "b")], "x string, y string"), f"{tmp_path}/r")
    (f,) = tmp_path.glob("r/*.csv")
    assert f.read_bytes() == b"x,y\r\n'=1,b\r\n"


def test_repeated_keys_and_batches(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":{"b":1}}',), ("{",)], "j string")
    assert [r.s for r in df.select(json_state("j").alias("s")).collect()] == ["duplicate_key", "ok", "malformed"]
    keys = spark.createDataFrame([(f"cve-2024-{i:05d}",) for i in range(250)] * 2 + [("bad",)], "k string")
    sizes = sorted(len(r["keys"]) for r in score_batches(keys, "k").collect())
    assert sizes == [50, 100, 100]
