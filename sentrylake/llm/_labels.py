"""Bounded samples of labelled texts, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of the labelled texts that a classifier is trained on, in all.
SAMPLE_BYTES = 48 << 20


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null for a null id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds


def _chosen(rows: list[tuple[int, int, int]], most_bytes: int) -> list[tuple[int, int]]:
    """(place, y) of rows(place, bytes, y) in order, each taken if it still fits: a long text is left out, not what follows."""
    out, left = [], most_bytes
    for place, size, y in rows:
        if size <= left:
            out.append((place, y))
            left -= size
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most `most` pairs of whole text and label of rows that `train` admits, in an order given by a hash of the id
    and then of the text; a text that does not fit into what is left of `most_bytes` bytes is passed over. These two bound
    what the driver holds: sizes are gathered first and only the texts that are taken after. Rows whose id, label or text
    is null are left out; an id labelled twice takes its larger label."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    marks = marks.where(train).groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounds the side that is sent to all
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    named = texts.select("doc_id", F.md5("text").alias("h"), F.octet_length("text").alias("size"))
    # equal texts under one id are alike; each is taken as often as it stands there
    found = [r for r in named.join(F.broadcast(marks), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most).collect()]
    taken = [(found[i], y) for i, y in _chosen([(i, r["size"], r.y) for i, r in enumerate(found)], most_bytes)]
    if not taken:
        return []
    keys = list({(r.doc_id, r.h) for r, _ in taken})
    wanted = docs.sparkSession.createDataFrame(keys, "doc_id long, h string")
    whole = texts.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi").withColumn("h", F.md5("text")).join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    by = {(r.doc_id, r.h): r.text for r in whole.collect()}
    return [(by[r.doc_id, r.h], y) for r, y in taken]
