"""Feed files to DataFrames. Live collection is not part of the library: a collector drops pages as files, and
these readers take any number of them in parallel."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import vulnerabilities as V
from ..functions.bounded_json import Bounds, bounded_state
from ..functions.text import free_of_markup, plain_text, required
from ..functions.times import parsed_timestamp
from ..operators.stored import stored

PAGE = "struct<startIndex:long,totalResults:long,vulnerabilities:array<string>>"


def vulnerability_pages(spark: SparkSession, path: str) -> DataFrame:
    """(start, total, n, json): the records of page files, and where each page stands in the whole."""
    pages = spark.read.text(path, wholetext=True)
    n = F.from_json("value", "startIndex long, totalResults long, vulnerabilities array<string>")
    return pages.select(n.alias("p")).select(F.col("p.startIndex").alias("start"), F.col("p.totalResults").alias("total"), F.size("p.vulnerabilities").alias("n"), F.explode("p.vulnerabilities").alias("json"))


def publication_page(feed: DataFrame, first, end, severity: str | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Normalised feed rows published in [first, end), of one severity, or only those that a catalog lists."""
    out = feed.where((F.col("published") >= F.lit(first)) & (F.col("published") < F.lit(end)))
    if severity is not None:
        out = out.where(F.col("severity") == severity.lower())
    return out if listed is None else out.join(listed.select("cve_id").distinct(), "cve_id", "left_semi")


def _filled(lengths: list[int], n: int, total: int, most: int, longest: int) -> tuple[list[int], tuple[int, int]]:
    """Where new batches begin in a part's ids, of these lengths, if the batch before has n ids of `total` characters (n is 0
    where there is none); and how many ids and characters the last batch has."""
    begins = []
    for i, length in enumerate(lengths):
        if n == 0 or n >= most or total + length + 1 > longest:
            begins.append(i)
            n = total = 0
        total += length + (n > 0)
        n += 1
    return begins, (n, total)


def _exits(lengths: list[int], most: int, longest: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """What a part does to whatever batch comes into it: the lengths of its first ids, with which the place of its first new
    batch can be told, and for each such place how many batches begin in it and how the last one stands. From a
    new batch on nothing depends on what was before, so that places share their further course."""
    n, at = len(lengths), 0
    ends, total = [], 0  # where a batch that begins at i ends
    for i in range(n):
        at = max(at, i)
        while at < n and at - i < most and (at == i or total + lengths[at] + 1 <= longest):
            total += lengths[at] + (at > i)
            at += 1
        ends.append((at, total))
        total -= lengths[i] + (at - i > 1)
    course = [(0, 0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        end, size = ends[i]
        course[i] = (1, end - i, size) if end == n else (course[end][0] + 1, *course[end][1:])
    return lengths[:most], course[: most + 1]


def _by_part(batches):
    """(part, rows) of rows that come part by part."""
    now, rows = None, []
    for b in batches:
        for part, key in zip(b["part"].to_pylist(), b["key"].to_pylist()):
            if rows and part != now:
                yield now, rows
                rows = []
            now = part
            rows.append(key)
    if rows:
        yield now, rows


def score_batches(df: DataFrame, key: str, most: int = 100, longest: int = 2000, place: str | None = None, parts: int | None = None) -> DataFrame:
    """(batch, keys): the distinct valid ids, in the order of their first `place`, then of length and id, filled one after
    another into batches of at most `most` ids whose query text, with a separator between two ids, is at most `longest`
    characters; batches count from 0. A longer id has a batch of its own.

    Which batch an id is in depends on all before it. Sorted parts are read side by side: each tells what it does to any
    batch that comes into it, at most `most` + 1 cases. These are composed in order (numbers in proportion to the parts,
    not to the ids), and then all parts are filled at once, each from the batch that comes into it."""
    at = F.col(place).cast("long") if place else F.lit(None).cast("long")
    ids = df.select(V.cve_id(key).alias("key"), at.alias("place")).where("key is not null").groupBy("key").agg(F.min("place").alias("place"))
    order = [F.col("place").asc_nulls_last(), F.length("key"), F.col("key")]
    kept = stored(ids.repartitionByRange(*([parts] if parts else []), *order).withColumn("part", F.spark_partition_id()), "requests")
    in_part = kept.repartition("part").sortWithinPartitions("part", *order).select("part", "key")

    def summarize(batches):
        for part, keys in _by_part(batches):
            first, course = _exits([len(k) for k in keys], most, longest)
            lists = [first, *([c[i] for c in course] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in lists)], ["part", "first", "begun", "ids", "size"])

    entries, n, total, batch = {}, 0, 0, -1
    for s in in_part.mapInArrow(summarize, "part int, first array<long>, begun array<long>, ids array<long>, size array<long>").orderBy("part").collect():
        entries[s.part] = n, total, batch
        new, now = _filled(s.first, n, total, most, longest)
        if new:
            batch, now = batch + s.begun[new[0]], (s.ids[new[0]], s.size[new[0]])
        n, total = now

    def fill(batches):
        for part, keys in _by_part(batches):
            n, total, batch = entries[part]
            new, out = set(_filled([len(k) for k in keys], n, total, most, longest)[0]), []
            for i in range(len(keys)):
                batch += i in new
                out.append(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(range(len(keys)), pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.string())], ["batch", "i", "part", "key"])

    filled = in_part.mapInArrow(fill, "batch long, i long, part int, key string")
    return filled.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "i", "key"))), lambda x: x["key"]).alias("keys"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Known-exploited catalogs: version, release, count and entries, with whether each may be used."""
    schema = "catalogVersion string, dateReleased string, count long, vulnerabilities array<" + V.CATALOG + ">"
    return V.catalog_complete(spark.read.schema(schema).json(path, multiLine=True))


def catalog_entries(catalogs: DataFrame) -> DataFrame:
    e = catalogs.where("complete").select(F.explode("vulnerabilities").alias("e"))
    return e.select(*V.normalized_catalog_entry("e"))


def entry_id(guid: str, link: str):
    """An entry's own id, else its link."""
    return F.coalesce(F.nullif(F.trim(F.col(guid)), F.lit("")), F.trim(F.col(link)))


def normalized_entries(raw: DataFrame, *also: str) -> DataFrame:
    """Of raw(title, link, guid, description, pubDate): title (null where it is blank or too long), link, external id
    (guid, else link), text summary, publication time; and the raw columns `also`."""
    return raw.select(*also, required("title", 500).alias("title"), F.trim("link").alias("link"), entry_id("guid", "link").alias("external_id"), plain_text("description").alias("summary"), parsed_timestamp("pubDate").alias("published"))


def by_author(entries: DataFrame, author: str, sources: dict[str, str], texts: list[str]) -> DataFrame:
    """Entries of a feed that several sources share, with the source of their author as `vendor`; entries of other
    authors, and those whose texts hold markup however often it is decoded, are left out."""
    vendor = F.try_element_at(F.create_map(*(F.lit(x) for pair in sources.items() for x in pair)), F.col(author))
    out = entries.withColumn("vendor", vendor).where(F.col("vendor").isNotNull())
    for c in texts:
        out = out.where(free_of_markup(F.coalesce(F.col(c), F.lit(""))))
    return out


def feed_allowed(c: str, nodes: int = 25_000, entries: int = 100):
    """Whether a feed text has no document type or entities, and not too many elements or entries."""
    x = F.col(c)
    return ~x.rlike(r"(?i)<!(DOCTYPE|ENTITY)") & (F.regexp_count(x, F.lit(r"<[a-zA-Z]")) <= nodes) & (F.regexp_count(x, F.lit(r"<item[\s>]")) <= entries)


def _strict(text):
    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("duplicate key")
        return dict(items)

    try:
        json.loads(text, object_pairs_hook=pairs)
    except (TypeError, ValueError) as e:
        return "duplicate_key" if "duplicate" in str(e) else "malformed"
    return "ok"


@F.pandas_udf(StringType())
def json_state(s: pd.Series) -> pd.Series:
    """'ok', 'malformed' or 'duplicate_key'; SQL functions take the last of repeated keys silently."""
    return s.map(_strict)


def publications(spark: SparkSession, path: str, most_bytes: int = 1 << 20, most: int = 100) -> DataFrame:
    """Records of publication files, as `publications_of` has them."""
    return publications_of(spark.read.text(path, wholetext=True), most_bytes, most)


def publications_of(texts: DataFrame, most_bytes: int = 1 << 20, most: int = 100) -> DataFrame:
    """Records of texts(value) of schema version 1; those that are too large, malformed or too long give none."""
    files = texts.where((F.octet_length("value") <= most_bytes) & (json_state("value") == "ok"))
    body = F.from_json("value", "schema_version int, source_slug string, publications array<struct<title:string,url:string,summary:string,published_at:string>>")
    rows = files.select(body.alias("b")).where((F.col("b.schema_version") == 1) & (F.size("b.publications") <= most))
    return rows.select(F.col("b.source_slug").alias("source"), F.explode("b.publications").alias("p")).select("source", required("p.title", 500).alias("title"), F.col("p.url").alias("url"), F.trim("p.summary").alias("summary"), parsed_timestamp("p.published_at").alias("published"))


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """(collection, place, token, following, more): how the collector came by each envelope file, for `walks.token_walks`."""
    head = F.from_json("value", "collection string, place long, token string, next string, more boolean")
    return spark.read.text(path, wholetext=True).select(head.alias("h")).select("h.collection", "h.place", "h.token", F.col("h.next").alias("following"), F.coalesce("h.more", F.lit(False)).alias("more"))


def bounded_objects(documents: DataFrame, value: str, *fields: str, bounds: Bounds = Bounds()) -> DataFrame:
    """Objects of the bundles and envelopes in a column of texts: the other columns, `fields` of the text, state, id, type,
    modified, created, creator, revoked, and the whole object as JSON. A text is scanned once before anything is built of
    it; one that breaks a bound, repeats a key, is malformed or no object with a list of objects gives one row with its
    state ('shape' for the last) and no object."""
    others = [c for c in documents.columns if c != value]
    kind = F.get_json_object(value, "$.objects")
    held = documents.withColumn("_state", bounded_state(F.col(value), bounds))
    state = F.when((F.col("_state") == "ok") & ~(F.trim(F.col(value), F.lit("\ufeff \t\r\n")).startswith("{") & F.coalesce(kind.startswith("["), F.lit(False))), "shape").otherwise(F.col("_state"))
    one = F.when(F.col("state") == "ok", F.from_json(kind, "array<string>"))
    rows = held.withColumn("state", state).select(*others, "state", *(F.when(F.col("state") == "ok", F.get_json_object(value, f"$.{f}")).alias(f) for f in fields), F.explode_outer(one).alias("payload"))
    g = lambda p: F.get_json_object("payload", f"$.{p}")
    return rows.select(*others, "state", *fields, g("id").alias("id"), g("type").alias("type"), parsed_timestamp(F.coalesce(g("modified"), g("created"))).alias("modified"), parsed_timestamp(g("created")).alias("created"), g("created_by_ref").alias("creator"), F.coalesce(g("revoked").cast("boolean"), F.lit(False)).alias("revoked"), "payload")


def stix_objects(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """Objects of bundle and envelope files within the bounds: `fields` of the file, id, type, modified, created, creator,
    revoked, and the whole as JSON. Files over 5 MiB are not read."""
    small = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= Bounds().size)
    return bounded_objects(small.select(F.decode("content", "UTF-8").alias("value")), "value", *fields).where("payload is not null").drop("state")


#: The kinds of object that are imported.
STAGED = ("malware", "campaign", "intrusion-set", "attack-pattern", "relationship", "identity", "marking-definition")


def staged(objects: DataFrame, payload: str) -> DataFrame:
    """objects with their `type` and whether it is one that is imported."""
    kind = F.get_json_object(payload, "$.type")
    return objects.select("*", kind.alias("type"), F.coalesce(kind.isin(*STAGED), F.lit(False)).alias("accepted"))
