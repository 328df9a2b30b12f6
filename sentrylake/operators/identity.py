"""Joint identity of publications: incoming rows against stored records, items and global identifiers, and against each
other, over all sources and batches at once.

A row sees what the rows before it have done, but only through keys that it shares with them: its source's external id
and url, and the url and title that name an item for all sources. So rows and the stored state are split into connected
components over those keys, and each component is read in order, its state kept as it goes. What no incoming row can
reach is left out before. Components are dealt out; one of them is one task, as its outcomes depend on their order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .stored import stored

_OUT = {"place": pa.int64(), "outcome": pa.string(), "reason": pa.string(), "record": pa.string(), "item": pa.string()}
_ROW = "component long, kind int, place long, id string, source string, external_id string, url_hash string, title_hash string, content_hash string, item string, item_type string, status string"


class _Ledger:
    """The state of one component."""

    def __init__(self):
        self.records: dict[str, dict] = {}
        self.at: dict[tuple, str] = {}  # (which key, source, value) to a record
        self.items: dict[str, tuple] = {}
        self.owner: dict[tuple, str] = {}  # (namespace, value) to an item
        self.named: dict[tuple, list] = {}  # (namespace, item) to its values

    def know(self, row: dict) -> None:
        """A stored item (kind 0), identifier (1) or record (2). The least id of a key that stands twice counts."""
        if row["kind"] == 0:
            self.items[row["id"]] = (row["item_type"], row["status"])
        elif row["kind"] == 1:
            # the namespace comes as source, the value as content hash
            self.owner.setdefault((row["source"], row["content_hash"]), row["item"])
            self.named.setdefault((row["source"], row["item"]), []).append(row["content_hash"])
        else:
            self.records[row["id"]] = {c: row[c] for c in ("source", "external_id", "url_hash", "content_hash", "item")}
            for c in ("external_id", "url_hash"):
                self.at.setdefault((c, row["source"], row[c]), row["id"])

    def usable(self, item: str | None, kind: str) -> bool:
        return self.items.get(item) == (kind, "active")

    def trouble(self, row: dict, item: str | None) -> str | None:
        """Why a row's url and title may not name the item (any item, where there is none yet)."""
        owners = [o for o in (self.owner.get(("url", row["url_hash"])), self.owner.get(("title", row["title_hash"]))) if o is not None]
        if item is not None and not self.usable(item, row["item_type"]):
            return "inactive_item"
        if item is not None and any(len(self.named.get((n, item), ())) > 1 for n in ("url", "title")):
            return "identity_conflict"
        if not all(self.usable(o, row["item_type"]) for o in owners) or len({*owners, *([item] if item else [])}) > 1:
            return "identity_conflict"
        return None

    def name(self, item: str, row: dict) -> None:
        """The item takes the row's url and title for what it had."""
        for namespace, value in (("url", row["url_hash"]), ("title", row["title_hash"])):
            for old in self.named.get((namespace, item), ()):
                if self.owner.get((namespace, old)) == item:
                    del self.owner[namespace, old]
            self.owner[namespace, value] = item
            self.named[namespace, item] = [value]

    def write(self, record: str, row: dict, item: str) -> None:
        old = self.records.get(record)
        for c in ("external_id", "url_hash"):
            if old is not None and self.at.get((c, row["source"], old[c])) == record:
                del self.at[c, row["source"], old[c]]
            self.at[c, row["source"], row[c]] = record
        self.records[record] = {c: row[c] for c in ("source", "external_id", "url_hash", "content_hash")} | {"item": item}

    def take(self, row: dict) -> tuple:
        """(outcome, reason, record, item) of an incoming row."""
        found = [r for r in (self.at.get((c, row["source"], row[c])) for c in ("external_id", "url_hash")) if r is not None]
        if len(set(found)) > 1:
            return "failed", "two_records", found[0], self.records[found[0]]["item"]
        if not found:
            if reason := self.trouble(row, None):
                return "failed", reason, None, None
            record, item = f"new:{row['place']}", self.owner.get(("url", row["url_hash"]))
            if item is None and ("title", row["title_hash"]) in self.owner:
                return "failed", "title_only", None, None
            if item is not None:
                # a row that is linked to an item gives it no name
                if reason := self.trouble(row, item):
                    return "failed", reason, None, None
                self.write(record, row, item)
                return "linked", None, record, item
            item = record
            self.items[item] = (row["item_type"], "active")
            self.name(item, row)
            self.write(record, row, item)
            return "created", None, record, item
        record = found[0]
        item = self.records[record]["item"]
        if reason := "inactive_item" if item is None else self.trouble(row, item):
            return "failed", reason, record, item
        self.name(item, row)
        if self.records[record]["content_hash"] == row["content_hash"]:
            return "unchanged", None, record, item
        self.write(record, row, item)
        return "updated", None, record, item


def _fold(batches):
    component, ledger = None, None
    for b in batches:
        out = []
        for row in b.to_pylist():
            if ledger is None or row["component"] != component:
                component, ledger = row["component"], _Ledger()
            if row["kind"] < 3:
                ledger.know(row)
            else:
                out.append((row["place"], *ledger.take(row)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), _OUT.values())], list(_OUT))


def _node(*parts) -> Column:
    return F.xxhash64(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def resolved_publications(incoming: DataFrame, records: DataFrame, items: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(place, outcome, reason, record, item) of each row of incoming(place, source, external_id, url_hash, title_hash,
    content_hash, item_type), in the order of place, which does not repeat, against records(id, source, external_id,
    url_hash, content_hash, item), items(id, item_type, status) and identifiers(namespace 'url' or 'title', value, item).

    A row whose external id and url belong to one record of its source is `unchanged` or, with other content, `updated`;
    either way its item takes the row's url and title. A row without a record is `linked` to the item that its url
    names, which gets no name by it, or `created` with an item of its own; records and items that are new are called
    'new:' and the place. It has `failed` by its reason: two_records (the keys are of different ones), identity_conflict
    (url or title name another item, one of another type, or one that is not active; or the item has several names),
    title_only (only the title is known), inactive_item (the record's item), missing_key (a null among the keys).
    Where the stored state has a key twice the least id counts. No rows, no outcomes."""
    keys = ["place", "source", "external_id", "url_hash", "title_hash", "content_hash", "item_type"]
    rows = incoming.select(F.col("place").cast("long").alias("place"), *(F.col(c).cast("string").alias(c) for c in keys[1:]))
    whole = F.lit(True)
    for c in ("source", "external_id", "url_hash", "title_hash"):
        whole = whole & F.col(c).isNotNull()
    bad = rows.where(~whole).select("place", F.lit("failed").alias("outcome"), F.lit("missing_key").alias("reason"), F.lit(None).cast("string").alias("record"), F.lit(None).cast("string").alias("item"))
    rows = rows.where(whole)
    text = lambda df, *names: df.select(*(F.col(n).cast("string").alias(n) for n in names))
    external, of_url = (lambda: _node("e", F.col("source"), F.col("external_id"))), (lambda: _node("r", F.col("source"), F.col("url_hash")))
    # the reachable part of the stored state: records with a key of a row, and all names of items so reached
    asked = rows.select(F.explode(F.array(external(), of_url(), _node("n", "url", F.col("url_hash")), _node("n", "title", F.col("title_hash")))).alias("asked")).distinct()
    recs = text(records, "id", "source", "external_id", "url_hash", "content_hash", "item").withColumns({"a": external(), "b": of_url()})
    hit = recs.select("id", F.explode(F.array("a", "b")).alias("asked")).join(asked, "asked", "left_semi").select("id").distinct()
    recs = stored(recs.join(hit, "id", "left_semi"), "reached")  # read for the links and again for the state
    named = text(identifiers, "namespace", "value", "item").withColumn("a", _node("n", F.col("namespace"), F.col("value")))
    reached = named.join(asked.withColumnRenamed("asked", "a"), "a", "left_semi").select("item").unionByName(recs.select("item")).where("item is not null").distinct()
    named = stored(named.join(reached, "item", "left_semi"), "named")
    found = text(items, "id", "item_type", "status").join(reached.withColumnRenamed("item", "id"), "id", "left_semi")
    own = lambda c: _node("i", F.col(c))
    first = of_url()
    pair = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    links = rows.select(F.inline(F.array(pair(first, external()), pair(first, _node("n", "url", F.col("url_hash"))), pair(first, _node("n", "title", F.col("title_hash"))))))
    links = links.unionByName(recs.select(F.inline(F.array(pair(F.col("a"), F.col("b")), pair(F.col("a"), F.coalesce(own("item"), F.col("a"))))))).unionByName(named.select(F.col("a").alias("u"), own("item").alias("v")))
    roots = components(links)
    shape = lambda df, kind, **given: df.select("node", F.lit(kind).alias("kind"), *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in _ROW.split(", ")[2:])))
    col = F.col
    parts = [
        shape(found.withColumn("node", own("id")), 0, id=col("id"), item_type=col("item_type"), status=col("status")),
        shape(named.withColumn("node", col("a")), 1, source=col("namespace"), content_hash=col("value"), item=col("item")),
        shape(recs.withColumn("node", col("a")), 2, **{c: col(c) for c in ("id", "source", "external_id", "url_hash", "content_hash", "item")}),
        shape(rows.withColumn("node", first), 3, **{c: col(c) for c in keys}),
    ]
    state = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    dealt = state.join(roots, "node").select(F.col("root").alias("component"), *[x.split()[0] for x in _ROW.split(", ")[1:]])
    ordered = dealt.repartition("component").sortWithinPartitions("component", "kind", "place", "id", "item", "content_hash")
    schema = "place long, outcome string, reason string, record string, item string"
    return ordered.mapInArrow(_fold, schema).unionByName(bad)
