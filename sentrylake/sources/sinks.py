"""Reports and metrics as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import neutral_cell
from .commits import CommitLog


def report_rows(df: DataFrame, columns: list[str], order: list, most: int = 100) -> DataFrame:
    """The first rows of a report, every cell as neutral text."""
    return df.orderBy(*order).limit(most).select(*(neutral_cell(c).alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, most_bytes: int = 2 << 20) -> None:
    """One CSV file with CRLF ends; a report over the size limit is an error."""
    size = df.agg(F.sum(sum((F.octet_length(c) + 3 for c in df.columns), F.lit(2)))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the report has {size} bytes; {most_bytes} are allowed")
    df.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


def record_lines(df: DataFrame, columns: list[str], width: int = 90) -> DataFrame:
    """A line 'name: value' for each cell, wrapped at a width; what a page layout prints."""
    cells = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns))
    rows = df.select(F.posexplode(cells).alias("place", "cell"), *columns)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("cell") - 1) / width).cast("int")), lambda i: F.substr("cell", i * width + 1, F.lit(width)))
    return rows.select(*columns, "place", F.posexplode(parts).alias("part", "line"))


def write_lines(lines: DataFrame, order: list[str], line: str, path: str, most_bytes: int = 2 << 20) -> None:
    """The lines of a report as one text file, in order; a report over the size limit is an error and nothing is written."""
    size = lines.agg(F.sum(F.octet_length(line) + 1)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the report has {size} bytes; {most_bytes} are allowed")
    lines.orderBy(*order).select(line).coalesce(1).write.mode("overwrite").text(path)


def metric_lines(metrics: DataFrame, prefix: str) -> DataFrame:
    """name and value rows as exposition text, with a help and a type line for each name."""
    name = F.concat(F.lit(prefix + "_"), F.col("name"))
    lines = F.array(F.concat(F.lit("# HELP "), name, F.lit(" "), F.initcap(F.replace("name", F.lit("_"), F.lit(" ")))), F.concat(F.lit("# TYPE "), name, F.lit(" gauge")), F.concat(name, F.lit(" "), F.col("value").cast("string")))
    return metrics.select("name", F.posexplode(lines).alias("place", "line"))


class VersionTaken(RuntimeError):
    """Another writer has committed the version."""


def write_state(state: DataFrame, root: str, version: int) -> None:
    """A table's next state beside its older ones. It is written to a folder of its own and then committed under its version,
    which is taken once: of writers who started from the same state one wins, and the others get VersionTaken. A write
    that fails commits nothing, so that the older state stays current and the write can be tried again."""
    folder = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    state.write.parquet(folder)
    if not CommitLog(state.sparkSession, root).put(version, folder):
        raise VersionTaken(f"version {version} of {root} has been committed by another writer")


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest state that was committed, or that of a version."""
    log = CommitLog(spark, root)
    version = log.newest() if version is None else version
    folder = None if version is None else log.read(version)
    if folder is None:
        raise LookupError(f"no state of {root} has been committed" + (f" as version {version}" if version is not None else ""))
    return spark.read.parquet(folder)
