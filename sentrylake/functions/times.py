"""Time expressions and windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col


def parsed_timestamp(c: str | Column, naive_is_utc: bool = False) -> Column:
    """ISO 8601 with an offset or Z, or RFC 2822; null for others, and for naive times unless they count as UTC."""
    x = F.trim(col(c))
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(x))
    rfc = F.when(x.rlike(r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4}"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]+, ", ""), r"(GMT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    naive = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"), F.try_to_timestamp(F.concat(x, F.lit("Z"))))
    return F.coalesce(iso, rfc, naive) if naive_is_utc else F.coalesce(iso, rfc)


def strict_date(c: str | Column) -> Column:
    x = col(c)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def date_chunks(spark: SparkSession, start: datetime, end: datetime, days: int) -> DataFrame:
    """(chunk, first, last): chunks that leave no gap and do not overlap; each ends a millisecond before the next."""
    row = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), F.lit(end).cast("timestamp_ntz").alias("z"))
    starts = row.select("z", F.posexplode(F.sequence("a", F.col("z") - F.expr("interval 1 millisecond"), F.expr(f"interval {days} days"))).alias("chunk", "first"))
    return starts.select("chunk", "first", F.least(F.col("first") + F.expr(f"interval {days} days"), "z").alias("next")).select("chunk", "first", (F.col("next") - F.expr("interval 1 millisecond")).alias("last"))


def slot_valid(c: str | Column, zone: str = "Asia/Dubai", minute: int = 17) -> Column:
    """Whether a UTC time is a slot: an even hour there, at the fixed minute, without seconds."""
    local = F.from_utc_timestamp(col(c).cast("timestamp"), zone)
    return (F.hour(local) % 2 == 0) & (F.minute(local) == minute) & (F.second(local) == 0)


def window_start(watermark: str | Column, slot: str | Column, initial_hours: int = 2, overlap_minutes: int = 5, most_days: int = 120) -> Column:
    """Where the span of changes to fetch up to the slot begins: a little before the watermark, or the last hours if there
    is none, but not before the longest span."""
    end = col(slot)
    start = F.coalesce(col(watermark) - F.expr(f"interval {overlap_minutes} minutes"), end - F.expr(f"interval {initial_hours} hours"))
    return F.greatest(start, end - F.expr(f"interval {most_days} days"))
