"""The last mark at or before a row, or the first at or after it, within a key of any size.

Time is cut into buckets, and rows and marks of one bucket of a key meet; what earlier buckets hold comes in as one value
for each bucket. So a key's rows are as many tasks as it has buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, bucket: int, name: str) -> DataFrame:
    """rows(keys, at, ...) with `name`: the largest of marks(keys, at) of the same keys that is not larger than the row's;
    null if there is none. `at` is a whole number, `bucket` the size of a bucket in its unit. Rows with a null key get
    null."""
    place = F.floor(F.col(at) / bucket)
    marked = marks.select(*keys, F.col(at).alias("_mark")).where(F.col("_mark").isNotNull()).distinct()
    tops = marked.groupBy(*keys, F.floor(F.col("_mark") / bucket).alias("_bucket")).agg(F.max("_mark").alias("_top"))
    wanted = rows.select(*keys, place.alias("_bucket")).distinct()
    # one value for each bucket that holds rows: the largest mark of all buckets before it
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = wanted.join(tops, [*keys, "_bucket"], "full").select(*keys, "_bucket", F.max("_top").over(before).alias("_carry"))
    both = rows.select("*", place.alias("_bucket"), F.col(at).alias("_at"), F.lit(None).cast("long").alias("_mark"))
    own = marked.select(*(F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes), F.floor(F.col("_mark") / bucket).alias("_bucket"), F.col("_mark").alias("_at"), "_mark")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at", F.col("_mark").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_row", F.lit(True)).unionByName(own.withColumn("_row", F.lit(False)))
    met = met.withColumn("_last", F.max("_mark").over(inside)).where("_row")
    return met.join(carry, [*keys, "_bucket"], "left").select(*rows.columns, F.coalesce("_last", "_carry").alias(name))


def first_after(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, bucket: int, name: str) -> DataFrame:
    """The same for the smallest mark that is not smaller than the row's number."""
    turn = lambda df: df.withColumn(at, -F.col(at))
    return turn(last_before(turn(rows), turn(marks), keys, at, bucket, name)).withColumn(name, -F.col(name))
