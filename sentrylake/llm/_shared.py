"""What the operators of this subpackage share: stored intermediates and Arrow text access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one is made if all run in one
    process; anywhere else that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sentrylake-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sentrylake-{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there. Shuffle files of the write go
    when it has ended, as nothing reads them any more."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the folders of stored frames on which nothing that is still to be read depends."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, rid): the rows of docs as structs, each with a number of its own that is stored."""
    return stored(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "rows")


def without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows(row, rid) whose number is not in gone(rid)."""
    return rows.join(gone, "rid", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in columns))


def all_but_first(groups: DataFrame) -> DataFrame:
    """(rid) of groups(rid, id, root): all rows of each root but that of least id (nulls last), then rid."""
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"), F.count(F.lit(1)).alias("n"))
    # stored, so that the exchange of the rows stands directly below the join and a very large group is split
    first = stored(least.where("n > 1").select("root", F.col("first.rid").alias("best")), "best")
    return groups.join(first, "root").where("rid <> best").select("rid")


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of texts that go to Python hold at most 1000 rows and 16 MB, for the session: Spark's own
    10000 rows of long texts, several times copied in a Python worker, are most of an executor's memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the int64 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges (i, j) of rows of about `most` bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shifts and odd multiplications), element by element."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(multiplier: int, n: int) -> np.ndarray:
    out = np.full(n, multiplier, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)
