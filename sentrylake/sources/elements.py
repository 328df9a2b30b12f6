"""Elements of HTML pages as rows' arrays, read with a stack of open elements, and what listings and metadata need of them."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bounded_json

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_UNSEEN = {"script", "style", "template", "noscript"}
ELEMENT = "struct<node:int,last:int,tag:string,classes:array<string>,attributes:map<string,string>,text:string>"
_ARROW = pa.list_(pa.struct([("node", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))
#: Pages whose elements a Python worker holds as objects at a time.
PAGES = 64


class _Tree(HTMLParser):
    def __init__(self, most_nodes: int, most_depth: int):
        super().__init__(convert_charrefs=True)
        self.most_nodes, self.most_depth = most_nodes, most_depth
        self.nodes: list[list] = []  # tag, attributes, last node in it, first and last piece of text
        self.open: list[int] = []
        self.pieces: list[tuple[str, bool]] = []  # text, and whether it is seen on the page
        self.refused = False

    def handle_starttag(self, tag, attrs):
        if self.refused or len(self.nodes) >= self.most_nodes or len(self.open) >= self.most_depth:
            self.refused = True
            return
        self.nodes.append([tag, dict(reversed(attrs)), len(self.nodes), len(self.pieces), len(self.pieces)])
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open and not self.refused:
            self._close()

    def _close(self):
        node = self.nodes[self.open.pop()]
        node[2], node[4] = len(self.nodes) - 1, len(self.pieces)

    def handle_endtag(self, tag):
        if any(self.nodes[i][0] == tag for i in self.open):
            while self.nodes[self.open[-1]][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.pieces.append((data, not any(self.nodes[i][0] in _UNSEEN for i in self.open)))

    def close(self):
        super().close()
        while self.open:
            self._close()


def read_elements(page: str | None, tags: frozenset[str], most_nodes: int = 50_000, most_depth: int = 512) -> list[dict] | None:
    """The elements of some tags, in page order; None of a page over the bounds. The elements within one are those from
    node + 1 to last. Text is what is seen in it, white space collapsed; of an element that is not seen, all as it stands."""
    tree = _Tree(most_nodes, most_depth)
    tree.feed(page or "")
    tree.close()
    if tree.refused:
        return None
    out = []
    for i, (tag, attributes, last, a, b) in enumerate(tree.nodes):
        if tag in tags:
            pieces = tree.pieces[a:b]
            text = "".join(p for p, _ in pieces) if tag in _UNSEEN else " ".join("".join(p for p, seen in pieces if seen).split())
            out.append({"node": i, "last": last, "tag": tag, "classes": (attributes.get("class") or "").split(), "attributes": {k: v or "" for k, v in attributes.items()}, "text": text})
    return out


def elements(html: str | Column, *tags: str) -> Column:
    """`read_elements` of a column of pages."""
    wanted = frozenset(tags)

    @F.arrow_udf(f"array<{ELEMENT}>")
    def read(pages: pa.Array) -> pa.Array:
        # some pages at a time: their elements as Python objects take many times the room of the pages
        parts = [pa.array([read_elements(p, wanted) for p in pages[i : i + PAGES].to_pylist()], _ARROW) for i in range(0, len(pages), PAGES)]
        return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    return read(F.col(html) if isinstance(html, str) else html)


def _of(array: Column, tag: str, classes: list[str]) -> Column:
    return F.filter(array, lambda e: (e["tag"] == tag) & (F.size(F.array_except(F.array(*map(F.lit, classes)).cast("array<string>"), e["classes"])) == 0))


def _within(array: Column, outer: Column) -> Column:
    return F.filter(array, lambda e: (e["node"] > outer["node"]) & (e["node"] <= outer["last"]))


def listing(pages: DataFrame, container: str, classes: list[str], heading: str, heading_classes: list[str], most: int = 50, link: str = r"^/[^\s]+$", shortest: int = 1) -> DataFrame:
    """(page_id, place, title, link, outcome) of the entries of listing pages, in page order.

    With `classes`, an entry is a trusted container: an element of that tag with all of the classes, however it is nested.
    It must hold one heading with one link, so that one around another is refused for its structure and the inner one
    counts. Without, each heading within a container is an entry. A page that repeats counts each time by itself.

    accepted; unsafe (a page over the bounds of elements or depth: one row); structure (not one heading, or not one link
    in it); invalid_url (the link is not of the site's form); invalid_title; duplicate (of an accepted link of the page, in
    any case); record_limit (beyond the first `most`)."""
    rows = pages.select("page_id", elements("html", container, heading, "a").alias("all"))
    held = _of(F.col("all"), container, classes)
    entries = held if classes else F.filter(_of(F.col("all"), heading, heading_classes), lambda e: F.exists("held", lambda c: (e["node"] > c["node"]) & (e["node"] <= c["last"])))
    rows = rows.withColumn("held", held).withColumn("entries", entries)
    heads = lambda e: _of(_within(F.col("all"), e), heading, heading_classes) if classes else F.array(e)

    def entry(e, i):
        found = heads(e)
        anchors = F.when(F.size(found) == 1, F.filter(_within(F.col("all"), F.get(found, F.lit(0))), lambda a: a["tag"] == "a"))
        anchor = F.when(F.size(anchors) == 1, F.get(anchors, F.lit(0)))
        title, href = anchor["text"], anchor["attributes"]["href"]
        bad = (
            F.when(i >= most, "record_limit")
            .when(href.isNull(), "structure")
            .when(~href.rlike(link), "invalid_url")
            .when((F.length(title) < shortest) | (F.length(title) > 500), "invalid_title")
        )
        return F.struct(i.alias("place"), title.alias("title"), href.alias("link"), bad.alias("bad"))

    rows = rows.select("page_id", F.when(F.col("all").isNull(), F.array(F.struct(F.lit(0).alias("place"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("link"), F.lit("unsafe").alias("bad")))).otherwise(F.transform("entries", entry)).alias("e"))
    earlier = lambda x: F.exists("e", lambda y: y["bad"].isNull() & (y["place"] < x["place"]) & (F.lower(y["link"]) == F.lower(x["link"])))
    outcome = lambda x: F.coalesce(x["bad"], F.when(earlier(x), "duplicate"), F.lit("accepted"))
    judged = F.transform("e", lambda x: F.struct(x["place"].alias("place"), x["title"].alias("title"), x["link"].alias("link"), outcome(x).alias("outcome")))
    return rows.select("page_id", F.inline(judged))


#: Bounds of data blocks in pages, and what types of object are a publication.
BLOCKS, BOUNDS = 10, bounded_json.Bounds(size=64 << 10, depth=8, nodes=1_000, string=10_000)
TYPES = {"Article", "NewsArticle", "BlogPosting", "Report", "TechArticle"}
_FIELDS = ("headline", "description", "datePublished", "dateModified")


def publication_data(blocks: list[str], url: str | None) -> dict:
    """What the data blocks of a page say of its publication: the object of a publication type, at any depth, whose url is
    the page's, or the only one there is if it names no url. `problem` is 'unsafe' (a bound, a repeated key or malformed) or
    'ambiguous'."""
    found = []
    if len(blocks) > BLOCKS or any(bounded_json.state(b, BOUNDS) != "ok" for b in blocks):
        return {"problem": "unsafe"}
    for block in blocks:
        todo = [json.loads(block)]
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                kinds = value.get("@type")
                if TYPES & {k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)}:
                    found.append(value)
                todo += reversed(value.values())
            elif isinstance(value, list):
                todo += reversed(value)

    def names(x):
        main = x.get("mainEntityOfPage")
        return {n for n in (x.get("url"), main.get("@id") if isinstance(main, dict) else main) if isinstance(n, str)}

    mine = [x for x in found if url is not None and names(x) == {url}]
    if not found:
        return {}
    if len(mine) != 1:
        mine = [x for x in found if not names(x)] if len(found) == 1 else []
    if len(mine) != 1:
        return {"problem": "ambiguous"}
    return {k: " ".join(v.split()) or None for k in _FIELDS if isinstance(v := mine[0].get(k), str)}


def data_of(blocks: Column, url: Column) -> Column:
    """`publication_data` of columns, as a struct."""

    @F.pandas_udf("string")
    def read(blocks: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(publication_data(list(b) if b is not None else [], u)) for b, u in zip(blocks, url)])

    return F.from_json(read(blocks, url), "headline string, description string, datePublished string, dateModified string, problem string")


def page_metadata(pages: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, title, summary, published, modified, problem) of pages(page_id, url, html): each from the page's data
    blocks, else from Open Graph and meta elements (attributes in any order), else, of the title, the title element.
    problem: unsafe or ambiguous, as in `publication_data` or for a page over the bounds of elements; then there is no more."""
    rows = pages.select("page_id", F.col(url).cast("string").alias("url"), elements("html", "script", "meta", "title").alias("all"))
    is_data = lambda e: (e["tag"] == "script") & (F.lower(F.trim(F.split_part(F.coalesce(e["attributes"]["type"], F.lit("")), F.lit(";"), F.lit(1)))) == "application/ld+json")
    rows = rows.withColumn("data", data_of(F.transform(F.filter("all", is_data), lambda e: e["text"]), F.col("url")))

    def meta(name):
        named = F.filter("all", lambda e: (e["tag"] == "meta") & (F.lower(F.coalesce(e["attributes"]["property"], e["attributes"]["name"])) == name))
        return F.nullif(F.trim(F.get(named, F.lit(0))["attributes"]["content"]), F.lit(""))

    title = F.nullif(F.get(F.filter("all", lambda e: e["tag"] == "title"), F.lit(0))["text"], F.lit(""))
    problem = F.when(F.col("all").isNull(), "unsafe").otherwise(F.col("data.problem"))
    fine = lambda c: F.when(F.col("problem").isNull(), c)
    return rows.withColumn("problem", problem).select(
        "page_id",
        fine(F.coalesce("data.headline", meta("og:title"), title)).alias("title"),
        fine(F.coalesce("data.description", meta("description"), meta("og:description"))).alias("summary"),
        fine(F.coalesce("data.datePublished", meta("article:published_time"))).alias("published"),
        fine(F.coalesce("data.dateModified", meta("article:modified_time"))).alias("modified"),
        "problem",
    )
