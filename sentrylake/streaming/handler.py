"""A source's handler: data first, then progress, and recovery of a run that was lost between the two."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog


class EvidenceConflict(RuntimeError):
    """What was committed for a run does not agree with its data or with the progress."""


def _counted(data: DataFrame, cursor: str) -> dict:
    """The counters of a run's data: rows, the last cursor and a sum of row hashes."""
    row = data.agg(F.count(F.lit(1)).alias("rows"), F.max(F.col(cursor).cast("string")).alias("text"), F.max(cursor).alias("cursor"), F.sum(F.xxhash64(*data.columns).cast("decimal(38,0)")).cast("string").alias("sum")).first()
    return {"rows": row["rows"], "cursor": row["cursor"], "sum": row["sum"]}


def reconstructed(spark: SparkSession, root: str, number: int, cursor: str) -> dict | None:
    """The evidence that a run left with its data, checked against that data; None if it has left none."""
    text = CommitLog(spark, f"{root}/data").read(number)
    if text is None:
        return None
    evidence = json.loads(text)
    found = _counted(spark.read.parquet(evidence["folder"]), cursor)
    if any(found[k] != evidence[k] for k in found):
        raise EvidenceConflict(f"run {number} of {root} has other data than it says")
    return evidence


def _advance(spark: SparkSession, root: str, number: int, evidence: dict) -> None:
    """The run's progress behind the last one: a cursor of numbers that does not go back. A run that has none changes nothing."""
    log = CommitLog(spark, f"{root}/progress")
    done = log.newest()
    if done is not None and done >= number:
        return
    before = json.loads(log.read(done))["cursor"] if done is not None else None
    now = evidence["cursor"] if evidence["cursor"] is not None else before
    if before is not None and now < before:
        raise EvidenceConflict(f"the cursor of {root} would go back from {before} to {now}")
    text = json.dumps({"cursor": now, "rows": evidence["rows"]})
    if not log.put(number, text) and json.loads(log.read(number)) != json.loads(text):
        raise EvidenceConflict(f"run {number} of {root} has other progress")


def source_handler(root: str, cursor: str, between: Callable[[int], None] = lambda number: None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits a run's data with its evidence, and then its progress, each once.

    A run that comes again finds what it has done: without evidence its data is written anew, and what was left in other
    folders is never read; with evidence but no progress, the progress is made from the evidence, which must agree with
    the data; with both nothing is done. `cursor` is a column of whole numbers; `between` is called between the two."""
    root = root.rstrip("/")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        evidence = reconstructed(spark, root, number, cursor)
        if evidence is None:
            folder = f"{root}/data/{uuid.uuid4().hex}"
            batch.write.parquet(folder)
            written = spark.read.schema(batch.schema).parquet(folder)
            evidence = {"folder": folder, **_counted(written, cursor)}
            if not CommitLog(spark, f"{root}/data").put(number, json.dumps(evidence)):
                evidence = reconstructed(spark, root, number, cursor)
        between(number)
        _advance(spark, root, number, evidence)

    return run


def handled(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all runs whose data was committed."""
    log = CommitLog(spark, f"{root.rstrip('/')}/data")
    folders = [json.loads(log.read(n))["folder"] for n in log.numbers()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def progress_of(spark: SparkSession, root: str) -> int | None:
    """The cursor that a source has reached."""
    log = CommitLog(spark, f"{root.rstrip('/')}/progress")
    return json.loads(log.read(log.newest()))["cursor"] if log.newest() is not None else None
