"""Progress of sources: watermarks with overlap, hash cursors, and writes that a replay does not repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import slot_valid


def since(df: DataFrame, modified: str, watermark: Column, overlap: str = "5 minutes") -> DataFrame:
    """Rows changed since a little before the watermark; what comes twice is absorbed by content."""
    return df.where(F.col(modified) >= watermark - F.expr(f"interval {overlap}"))


def deduplicated_stream(stream: DataFrame, modified: str, keys: list[str], late: str = "5 minutes") -> DataFrame:
    """A stream in which each version of a record comes once within the overlap."""
    return stream.withWatermark(modified, late).dropDuplicatesWithinWatermark(keys)


def next_watermark(outcomes: DataFrame, status: str, slot: Column, previous: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, watermark), one row without keys: the slot if all runs were a success or had no change, else the previous
    watermark; never back."""
    good = F.bool_and(F.col(status).isin("success", "no_change"))
    return outcomes.groupBy(*keys).agg(good.alias("good")).select(*keys, F.when(F.coalesce("good", F.lit(False)), F.greatest(slot, previous)).otherwise(previous).alias("watermark"))


def cursor(catalog_hash: Column, at: Column) -> Column:
    return F.concat(F.lit("sha256="), catalog_hash, F.lit(";cursor="), at.cast("string"))


def resumed(token: Column, catalog_hash: Column) -> Column:
    """The place at which to go on: that of the token, or 0 if the catalog has changed since."""
    same = F.regexp_extract(token, r"^sha256=([0-9a-f]{64});cursor=\d+$", 1) == catalog_hash
    return F.when(same, F.regexp_extract(token, r";cursor=(\d+)$", 1).cast("long")).otherwise(F.lit(0).cast("long"))


def server_cursor(previous: Column, offered: Column, skipped: Column) -> Column:
    """The next cursor of a feed that dates its pages: none if nothing new or something was skipped; going back is an error."""
    return F.when(offered < previous, F.raise_error(F.lit("the server's date went back"))).when((skipped > 0) | offered.isNull() | (offered == previous), None).otherwise(offered)


def once(write: Callable[[DataFrame, int], None], log: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch, then notes its number; a replayed batch is skipped.

    A crash between the two repeats the write, so `write` must overwrite by batch number (its own folder)."""

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        path = f"{log.rstrip('/')}/batch={number}"
        try:
            done = not spark.read.schema("number long").parquet(path).isEmpty()
        except Exception as e:  # Spark has no test for a path of any store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = False
        if not done:
            write(batch, number)
            spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(path)

    return run


def feed_digests(entries: DataFrame, source: str, key: str, content: str, run: int = 1000) -> DataFrame:
    """(source, digest) of entries with whole-number keys: a tree of SHA-256 over 'key:hash' of runs of keys, then of runs
    of run digests, and so on, each in order, so that no source's entries meet in one row."""
    level = entries.select(F.col(source).alias("source"), F.col(key).cast("long").alias("k"), F.concat(F.col(key).cast("string"), F.lit(":"), F.sha2(F.col(content), 256)).alias("h"))
    for _ in range(3):
        parts = level.groupBy("source", F.floor(F.col("k") / run).alias("at")).agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("l"))
        level = parts.select("source", F.col("at").alias("k"), F.sha2(F.array_join(F.transform("l", lambda e: e["h"]), ","), 256).alias("h"))
    rest = level.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("l"))
    return rest.select("source", F.sha2(F.array_join(F.transform("l", lambda e: e["h"]), ","), 256).alias("digest"))


def feed_changes(feeds: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, outcome) of feeds(source, digest, rejected): no_change where the stored(source, digest) is the same and no
    record was rejected, else process."""
    j = feeds.join(stored.select("source", F.col("digest").alias("_old")), "source", "left")
    return j.select("source", F.when((F.col("rejected") == 0) & F.col("_old").eqNullSafe(F.col("digest")), "no_change").otherwise("process").alias("outcome"))


def write_changed(entries: DataFrame, changes: DataFrame, source: str, path: str) -> bool:
    """Appends the entries of sources that have changed, and tells whether there were any; nothing is written otherwise."""
    todo = changes.where("outcome = 'process'").select(F.col("source").alias("_source")).distinct()
    if todo.isEmpty():
        return False
    entries.join(todo, F.col(source) == F.col("_source"), "left_semi").write.mode("append").parquet(path)
    return True


def schedule(ticks: DataFrame, at: str, place: str, step: int = 5, most: int = 300) -> DataFrame:
    """ticks with `slot`, the trigger's time in UTC if it is one of the two-hourly slots and else null, and `delay`, the
    seconds by which the source at a place of the list is put off."""
    return ticks.withColumn("slot", F.when(slot_valid(F.col(at)), F.col(at))).withColumn("delay", F.least(F.col(place) * step, F.lit(most)))


def retry_delay(attempt: str | Column, transient: str | Column, most: int = 3, delays: tuple[int, ...] = (30, 60)) -> Column:
    """Seconds until the next attempt; null if there is none: after the last one, or where the failure is not transient."""
    n, again = (F.col(c) if isinstance(c, str) else c for c in (attempt, transient))
    seconds = F.element_at(F.array(*map(F.lit, delays)), F.least(F.greatest(n, F.lit(1)), F.lit(len(delays))).cast("int"))
    return F.when(again & (n < most), seconds)
