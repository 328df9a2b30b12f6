"""Entries of RSS and Atom files, pulled while a file is read and held to bounds as they come."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which element's text is which column, of RSS items and Atom entries.
_TEXTS = {"title": "title", "guid": "guid", "id": "guid", "description": "description", "summary": "description", "pubdate": "published", "published": "published", "date": "published", "updated": "updated", "author": "author", "creator": "author", "name": "author"}
_COLUMNS = ["title", "link", "guid", "description", "published", "updated", "author"]
_SCHEMA = "path string, place int, problem string, kind string, " + ", ".join(f"{c} string" for c in _COLUMNS)


class _Refused(Exception):
    pass


class _Feed:
    def __init__(self, nodes: int, depth: int, entries: int):
        self.most = nodes, depth, entries
        self.nodes, self.path, self.now, self.text, self.out, self.kind = 0, [], None, None, [], None
        p = self.parser = expat.ParserCreate(namespace_separator=" ")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.data
        p.StartDoctypeDeclHandler = p.EntityDeclHandler = self.doctype

    def doctype(self, *_):
        raise _Refused("doctype")

    def start(self, name, attributes):
        tag = name.rpartition(" ")[2].lower()
        self.nodes += 1
        self.path.append(tag)
        if self.nodes > self.most[0] or len(self.path) > self.most[1]:
            raise _Refused("nodes" if self.nodes > self.most[0] else "depth")
        if self.now is None and tag in ("item", "entry"):
            if len(self.out) >= self.most[2]:
                raise _Refused("entries")
            self.kind, self.now, self.inside = "rss" if tag == "item" else "atom", {}, len(self.path)
        elif self.now is not None:
            if tag == "link" and attributes.get("href") and attributes.get("rel", "alternate") == "alternate":
                self.now.setdefault("link", attributes["href"])
            self.text = []

    def data(self, text):
        if self.text is not None:
            self.text.append(text)

    def end(self, name):
        tag = self.path.pop()
        if self.now is not None and len(self.path) < self.inside:
            self.out.append({**self.now, "kind": self.kind})
            self.now = None
        elif self.now is not None and self.text is not None:
            text, column = "".join(self.text).strip(), "link" if tag == "link" else _TEXTS.get(tag)
            if text and column and (len(self.path) == self.inside or tag == "name"):
                self.now.setdefault(column, text)
        self.text = None


def pulled(content: bytes, nodes: int = 25_000, depth: int = 32, entries: int = 100) -> tuple[list[dict], str | None]:
    """(entries, problem) of a feed's bytes. A feed with a document type or entity, or over a bound, gives no entries: doctype,
    nodes, depth, entries. One that is cut or malformed gives the entries before the fault, and is `malformed` only if
    there are none."""
    feed = _Feed(nodes, depth, entries)
    try:
        for i in range(0, max(1, len(content)), 1 << 16):
            feed.parser.Parse(content[i : i + (1 << 16)], False)
        feed.parser.Parse(b"", True)
    except _Refused as e:
        return [], str(e)
    except expat.ExpatError:
        return feed.out, None if feed.out else "malformed"
    return feed.out, None


def feed_entries(spark: SparkSession, path: str, most_bytes: int = 5 << 20, nodes: int = 25_000, depth: int = 32, entries: int = 100, glob: str | None = None) -> DataFrame:
    """The entries of RSS and Atom files, as `entries_of` has them. Files over `most_bytes` are not opened."""
    read = spark.read.format("binaryFile")
    files = (read.option("pathGlobFilter", glob) if glob else read.option("recursiveFileLookup", "true")).load(path)
    return entries_of(files, most_bytes, nodes, depth, entries)


def entries_of(files: DataFrame, most_bytes: int = 5 << 20, nodes: int = 25_000, depth: int = 32, entries: int = 100) -> DataFrame:
    """(path, place, problem, kind, title, link, guid, description, published, updated, author) of the entries of
    files(path, length, content), in order; a file without any that has a problem gives one row with its place null. Files
    over `most_bytes` have the problem size."""

    def run(batches):
        for b in batches:
            rows = []
            for name, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                found, problem = pulled(content, nodes, depth, entries)
                rows += [(name, i, None, e["kind"], *(e.get(c) for c in _COLUMNS)) for i, e in enumerate(found)]
                if problem:
                    rows.append((name, None, problem, *[None] * (len(_COLUMNS) + 1)))
            types = [pa.string(), pa.int32(), *[pa.string()] * (len(_COLUMNS) + 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "place", "problem", "kind", *_COLUMNS])

    pulled_rows = files.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(run, _SCHEMA)
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("int").alias("place"), F.lit("size").alias("problem"), *(F.lit(None).cast("string").alias(c) for c in ("kind", *_COLUMNS)))
    return pulled_rows.unionByName(large)
