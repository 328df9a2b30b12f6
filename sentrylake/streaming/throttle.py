"""Rate limits and failure windows, in batch and as stateful streams."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.asof import first_after, last_before
from ..operators.stored import stored


def recent(df: DataFrame, keys: list[str], at: str, seconds: int, tie: str) -> DataFrame:
    """How many events of the same key lie in the window that ends with each event, itself included."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("recent", F.count(F.lit(1)).over(w))


def fixed_windows(window_seconds: float, limit: int, block_seconds: float):
    """A function for applyInPandasWithState: failures(key, at) to (key, at, failures, blocked).

    A window begins with its first failure and counts until it is over; at the limit the key is blocked from then
    on. The state of a key is three numbers, whatever its number of events; it goes once it has expired."""

    def run(key, batches, state: GroupState):
        count, begun, until = state.get if state.exists else (0, 0.0, 0.0)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at in rows["at"]:
            now = at.timestamp()
            if now >= begun + window_seconds:
                count, begun = 0, now
            count += 1
            if count >= limit:
                until = now + block_seconds
            out.append((key[0], at, count, now < until))
        state.update((count, begun, until))
        state.setTimeoutTimestamp(int((max(begun + window_seconds, until) + 1) * 1000))
        yield pd.DataFrame(out, columns=["key", "at", "failures", "blocked"])

    return run


def failure_stream(failures: DataFrame, key: str, at: str, window_seconds: float, limit: int, block_seconds: float, late: str = "1 minute") -> DataFrame:
    """The stream of a failure stream's counts and blocks; events may be late by `late`."""
    rows = failures.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(fixed_windows(window_seconds, limit, block_seconds), "key string, at timestamp, failures long, blocked boolean", "count long, begun double, until double", "append", GroupStateTimeout.EventTimeTimeout)


def window_starts(events: DataFrame, keys: list[str], at: str, window: int, bucket: int) -> DataFrame:
    """(keys, at) of the events that begin a window: the first of a key, and each first one that is `window` or more after
    the last beginning. Each event points to the first that is a window later, and the beginnings are what the first event
    reaches: pointers are squared and what has been reached is followed by them, so that a key of n windows takes about
    log2(n) rounds of joins by key and time."""
    own = events.select(*keys, at).distinct()
    ahead = first_after(own.withColumn(at, F.col(at) + window), own, keys, at, bucket, "to")
    jumps = stored(ahead.select(*keys, (F.col(at) - window).alias(at), "to").where("to is not null"), "jumps")
    reached = stored(own.groupBy(*keys).agg(F.min(at).alias(at)), "reached")
    while not jumps.isEmpty():
        more = reached.join(jumps, [*keys, at]).select(*keys, F.col("to").alias(at))
        reached = stored(reached.unionByName(more).distinct(), "reached")
        onward = jumps.select(*keys, F.col(at).alias("to"), F.col("to").alias("next"))
        jumps = stored(jumps.join(onward, [*keys, "to"]).select(*keys, at, F.col("next").alias("to")), "jumps")
    return reached


def failure_batch(failures: DataFrame, key: str, at: str, window_seconds: float, limit: int, block_seconds: float) -> DataFrame:
    """The same over a finished table: (key, at, failures, blocked). Windows that begin with a failure depend on all before;
    their beginnings are found by doubling pointers, and counted within. No step reads a key's events in one task: windows
    and buckets of time are what is dealt. Rows with a null key or time are left out; equal rows count each for itself."""
    size, block = round(window_seconds * 1_000_000), round(block_seconds * 1_000_000)
    rows = failures.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).where("key is not null and at is not null")
    rows = stored(rows.select("key", "at", F.unix_micros("at").alias("us")), "failures")
    starts = window_starts(rows, ["key"], "us", size, size)
    begun = last_before(rows, starts, ["key"], "us", size, "begun")
    counted = begun.withColumn("failures", F.row_number().over(Window.partitionBy("key", "begun").orderBy("us")).cast("long"))
    full = counted.where(F.col("failures") >= limit)
    # of equal times only those that come from the one at the limit on are blocked
    blocks = full.groupBy("key", "us").agg(F.min("failures").alias("first"), F.max("begun").alias("begun"))
    last = last_before(counted, blocks.select("key", "us"), ["key"], "us", max(size, block), "full")
    earlier = last_before(counted.select("key", F.col("us").alias("now"), (F.col("us") - 1).alias("us")).distinct(), blocks.select("key", "us"), ["key"], "us", max(size, block), "before").select("key", F.col("now").alias("us"), "before")
    at_limit = F.col("failures") >= limit
    until = F.when(at_limit | (F.col("full") < F.col("us")), F.col("full")).otherwise(F.col("before"))
    blocked = F.coalesce(F.col("us") < until + block, F.lit(False))
    return last.join(earlier, ["key", "us"], "left").select("key", "at", "failures", blocked.alias("blocked"))


def _admit(state: list[int], now: int, window: int, limit: int) -> tuple[bool, list[int]]:
    """Whether a request may pass, and the times of those that passed within the window."""
    kept = [x for x in state if x > now - window]
    return (True, [*kept, now]) if len(kept) < limit else (False, kept)


def admissions(df: DataFrame, keys: list[str], at: str, seconds: int, limit: int, tie: str, windows: int = 16) -> DataFrame:
    """df with `admitted`: whether a request passes where at most `limit` requests of a key that passed may lie in the
    `seconds` that end with it. A refused request does not count. Requests of one time are taken by `tie`.

    A decision depends on those before it, but not without end: if the requests of a whole window, refused ones counted
    too, never were more than the limit, all of them passed, and what follows begins with them. Time is cut into buckets of
    `windows` windows; a bucket whose last window may have been over the limit is read together with the next, others
    each for itself, with the window before as it passed. Only a key that is over its limit all the time is one task, which
    holds `limit` times. Rows with a null time are refused."""
    window = seconds * 1_000_000
    size = window * windows
    clash = [c for c in df.columns if c.startswith("_")]
    if clash:
        raise ValueError(f"columns {clash} would clash with the operator's own")
    rows = df.withColumns({"_us": F.unix_micros(F.col(at).cast("timestamp")), "_key": F.xxhash64(*keys)})
    timed = rows.where("_us is not null")
    bucket = F.floor(F.col("_us") / size)
    # all requests of the window that ends with each of a bucket's last window, counted within the bucket
    spread = Window.partitionBy("_key", *keys, "_bucket").orderBy("_us").rangeBetween(-window + 1, 0)
    own = timed.select("_key", *keys, "_us", bucket.alias("_bucket")).withColumn("_recent", F.count(F.lit(1)).over(spread))
    over = (F.col("_recent") > limit) & (F.col("_us") > (F.col("_bucket") + 1) * size - window)
    buckets = own.groupBy("_key", *keys, "_bucket").agg(F.bool_or(over).alias("_over"))
    along = Window.partitionBy("_key", *keys).orderBy("_bucket")
    held = (F.lag("_bucket").over(along) == F.col("_bucket") - 1) & F.lag("_over").over(along)
    segments = buckets.withColumn("_fresh", F.when(F.coalesce(held, F.lit(False)), None).otherwise(F.col("_bucket"))).withColumn("_segment", F.max("_fresh").over(along)).select("_key", *keys, "_bucket", "_segment")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("_key", "_bucket", *keys)]
    dealt = timed.withColumn("_bucket", bucket).alias("r").join(segments.alias("s"), same).select("r.*", "s._segment").drop("_bucket").withColumn("_own", F.lit(True))
    # the last window of a bucket is also what the next one begins with, if that begins a segment
    tail = dealt.where(F.pmod(F.col("_us"), F.lit(size)) >= size - window).withColumn("_next", bucket + 1)
    halo = tail.where(F.col("_next") > F.col("_segment")).alias("r").join(segments.where("_segment = _bucket").alias("s"), [F.col("r._next") == F.col("s._bucket"), *(F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("_key", *keys))]).select(*(F.col(f"r.{c}").alias(c) for c in rows.columns), F.col("s._segment").alias("_segment"), F.lit(False).alias("_own"))
    ordered = dealt.unionByName(halo).withColumn("_group", F.xxhash64("_segment", *keys)).repartition("_group").sortWithinPartitions("_group", "_key", "_segment", "_us", tie)
    plain = df.columns

    def run(batches):
        group, state = None, []
        for b in batches:
            keep, passed = [], []
            for i, (g, k, s, now, mine) in enumerate(zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("_group", "_key", "_segment", "_us", "_own")))):
                if group != (g, k, s):
                    group, state = (g, k, s), []
                if not mine:
                    state = [*state, now]
                    continue
                ok, state = _admit(state, now, window, limit)
                keep.append(i)
                passed.append(ok)
            out = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(out.column(out.schema.names.index(c)) for c in plain), pa.array(passed, pa.bool_())], [*plain, "admitted"])

    schema = StructType([*df.schema.fields, StructField("admitted", BooleanType())])
    return ordered.mapInArrow(run, schema).unionByName(rows.where("_us is null").select(*df.columns, F.lit(False).alias("admitted")))


def admission_stream(requests: DataFrame, key: str, at: str, seconds: int, limit: int, late: str = "1 minute") -> DataFrame:
    """The same of a stream of requests, as they come: (key, at, admitted). A key's state is the times of the requests that
    passed in its last window, `limit` at most; it goes when the watermark has passed them."""
    window = seconds * 1_000_000

    def run(k, batches, state: GroupState):
        times = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for t in rows["at"]:
            ok, times = _admit(times, t.value // 1000, window, limit)
            out.append((k[0], t, ok))
        state.update((times,))
        if times:
            state.setTimeoutTimestamp((times[-1] + window) // 1000 + 1000)
        yield pd.DataFrame(out, columns=["key", "at", "admitted"])

    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, admitted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def bucketed(df: DataFrame, at: str, size: str, *keys: str | Column) -> DataFrame:
    """Tumbling event-time counts, on a stream or a table."""
    return df.groupBy(F.window(at, size), *keys).count()
