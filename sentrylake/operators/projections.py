"""Read models: serialised items, runs, cycles, progress, labels and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence_level(c: str | Column) -> Column:
    """High from 0.9, Medium from 0.75, else Low; null outside 0 to 1."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when((x < 0) | (x > 1), None).when(x >= 0.9, "High").when(x >= 0.75, "Medium").when(x >= 0, "Low")


def confidence_percent(c: str | Column) -> Column:
    """The nearest whole percentage, halves up."""
    x = F.col(c) if isinstance(c, str) else c
    return F.floor(x * 100 + 0.5).cast("long")


def duration_seconds(start: str, end: str) -> Column:
    """Seconds with microseconds; 0 at least; null for an open run."""
    micros = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return F.when(F.col(end).isNotNull(), F.greatest(F.lit(0), micros) / 1e6)


def iso_utc(c: str | Column) -> Column:
    """ISO 8601 in UTC with an offset; microseconds only where they are not zero."""
    x = F.col(c) if isinstance(c, str) else c
    whole = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(x, "SSSSSS")
    return F.concat(whole, F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


def progress_fingerprint(public_id: str, kind: str, version: str, at: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(public_id).cast("string"), F.col(kind), F.col(version).cast("string"), iso_utc(at)), 256)


def serialised_item(items: DataFrame, primary: DataFrame) -> DataFrame:
    """Items with the dates of their primary record. If there is a record its dates win, even if null."""
    r = primary.select(F.col("item_id").alias("_item"), F.lit(True).alias("_has"), F.col("published").alias("_published"), "source")
    joined = items.join(r, items["id"] == r["_item"], "left")
    return joined.select("id", "item_type", F.when(F.col("_has"), F.col("_published")).otherwise(F.col("published")).alias("published"), "source", F.col("confidence").cast("double").alias("confidence"))


def serialised_article(items: DataFrame, primary: DataFrame) -> DataFrame:
    """Articles with the date of their primary record, or their own where that is null."""
    r = primary.select(F.col("item_id").alias("_item"), F.col("published").alias("_published"), "source")
    return items.join(r, items["id"] == r["_item"], "left").select("id", "item_type", F.coalesce("_published", "published").alias("published"), "source")


def tag_kind(slug: str, kinds: dict[str, str]) -> Column:
    """The kind of the first prefix that a slug has."""
    out = F.lit(None).cast("string")
    for prefix, kind in reversed(kinds.items()):
        out = F.when(F.col(slug).startswith(prefix), kind).otherwise(out)
    return out


def evidence_tags(tags: DataFrame, kinds: dict[str, str], slug: str = "slug", confidence: str = "confidence") -> DataFrame:
    """Tags of a known kind that have a confidence, with their kind and an evidence text."""
    kind = tag_kind(slug, kinds)
    return tags.where(F.col(confidence).isNotNull()).withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("evidence", F.concat(F.lit("Controlled "), F.col("kind"), F.lit(" tag.")))


def json_details(c: str) -> Column:
    return F.from_json(F.col(c), "map<string,string>")
