"""Operators whose rows see what earlier rows of their batch have done.

A batch is one feed's entries, of which a feed has a bounded number (`feed_allowed`), so a fold's state is bounded
too. Batches are dealt by their key and each is read in its order; rows stream through, and no batch is gathered.
Batches of one call see the state before the call, not each other."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, batch: str, order: str, fresh: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """For each row of df, in its batch's order, what the batch's own step function gives; `fresh` makes one for each
    batch. Rows without a batch are a batch of their own."""
    rows = df.repartition(batch).sortWithinPartitions(batch, order)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(parts):
        now, step = None, None
        for part in parts:
            out = []
            for row in part.astype(object).where(part.notna(), None).to_dict("records"):
                if step is None or row[batch] != now:
                    now, step = row[batch], fresh()
                out.append(step(row))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def _acceptance() -> Callable[[dict], dict]:
    contents: list = []  # of the rows accepted so far, which are known by their number
    holder: tuple[dict, dict] = ({}, {})  # which of them has a key

    def step(row):
        keys = row["first_key"], row["second_key"]
        holders = [known.get(key) for known, key in zip(holder, keys)]
        if holders == [None, None]:
            for known, key in zip(holder, keys):
                known[key] = len(contents)
            contents.append(row["content"])
            outcome = "accepted"
        elif holders[0] == holders[1] and contents[holders[0]] == row["content"]:
            outcome = "duplicate"
        else:
            outcome = "conflict"
        return {"batch": row["batch"], "place": row["place"], "identity": outcome}

    return step


def accepted_in_order(df: DataFrame, batch: str, order: str, first_key: str, second_key: str, content: str) -> DataFrame:
    """(batch, place, identity): 'accepted' where neither key was accepted before in the batch, 'duplicate' where the row
    that has both keys has the same content, else 'conflict'."""
    rows = df.select(F.col(batch).cast("string").alias("batch"), F.col(order).cast("long").alias("place"), *(F.col(c).cast("string").alias(n) for c, n in ((first_key, "first_key"), (second_key, "second_key"), (content, "content"))))
    return in_order(rows, "batch", "place", _acceptance, "batch string, place long, identity string")


def _upserts() -> Callable[[dict], dict]:
    records: dict = {}  # by id, of those that the batch has touched: [external id, url hash, content hash]
    by_id: dict = {}
    by_url: dict = {}
    names = iter(range(1, 1 << 62))

    def step(row):
        e, u, h = row["external_id"], row["url_hash"], row["content_hash"]

        def found(mine, key, stored, at):
            if key in mine:
                return mine[key]
            # what was stored before the batch counts unless the batch has given that record another key
            return stored if stored is not None and (stored not in records or records[stored][at] == key) else None

        for name in ("by_id", "by_url"):
            if row[name] is not None and row[name] not in records:
                records[row[name]] = [row[f"{name}_{k}"] for k in ("external", "url", "content")]
        a, b = found(by_id, e, row["by_id"], 0), found(by_url, u, row["by_url"], 1)
        if a is not None and b is not None and a != b:
            return {"batch": row["batch"], "place": row["place"], "record": a, "outcome": "failed"}
        record, outcome = (a if a is not None else b), "created"
        if record is None:
            record = f"new:{next(names)}"
        else:
            old = records[record]
            outcome = "unchanged" if old[2] == h else "updated"
            if outcome == "unchanged":
                return {"batch": row["batch"], "place": row["place"], "record": record, "outcome": outcome}
            for mine, key in ((by_id, old[0]), (by_url, old[1])):
                if mine.get(key) == record:
                    del mine[key]
        records[record] = [e, u, h]
        by_id[e] = by_url[u] = record
        return {"batch": row["batch"], "place": row["place"], "record": record, "outcome": outcome}

    return step


def publication_outcomes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(batch, place, record, outcome) of incoming(batch, place, external_id, url_hash, content_hash) against
    current(id, external_id, url_hash, content_hash) and the rows before it in its batch.

    Matches of both keys on different records fail; no match creates a record, named 'new:1' and on in each batch; an equal
    content is unchanged; else the record takes the row's keys and content, and what it had matches no more. Where a key
    stands twice in current the least id counts."""
    pick = F.min_by(F.struct(F.col("id").cast("string").alias("id"), "external_id", "url_hash", "content_hash"), "id")
    side = lambda key, name: current.groupBy(F.col(key).alias(f"{name}_key")).agg(pick.alias("one")).select(f"{name}_key", F.col("one.id").alias(name), *(F.col(f"one.{c}").alias(f"{name}_{k}") for k, c in (("external", "external_id"), ("url", "url_hash"), ("content", "content_hash"))))
    rows = incoming.select(F.col("batch").cast("string").alias("batch"), F.col("place").cast("long").alias("place"), "external_id", "url_hash", "content_hash")
    met = rows.join(side("external_id", "by_id"), F.col("external_id") == F.col("by_id_key"), "left").join(side("url_hash", "by_url"), F.col("url_hash") == F.col("by_url_key"), "left")
    return in_order(met.drop("by_id_key", "by_url_key"), "batch", "place", _upserts, "batch string, place long, record string, outcome string")


#: What a run's state may turn into; the other states are final.
TRANSITIONS = {
    None: ["running"],
    "running": ["checkpoint_pending", "success", "no_change", "partial", "failed", "cancelled", "quota_deferred", "credentials_missing", "approval_pending", "licence_required", "disabled"],
    "checkpoint_pending": ["success", "no_change", "failed", "cancelled"],
}


def _transitions() -> Callable[[dict], dict]:
    state: list = [None]

    def step(row):
        legal = row["status"] in TRANSITIONS.get(state[0], ())
        if legal:
            state[0] = row["status"]
        return {"run": row["run"], "sequence": row["sequence"], "legal": legal, "state": state[0]}

    return step


def run_states(events: DataFrame, run: str, sequence: str, status: str) -> DataFrame:
    """(run, sequence, legal, state): a run's state after each of its events, in order of their sequence. An event whose
    status the state may not turn into is refused and changes nothing. A run has at most some hundred events."""
    rows = events.select(F.col(run).cast("string").alias("run"), F.col(sequence).cast("long").alias("sequence"), F.col(status).cast("string").alias("status"))
    return in_order(rows, "run", "sequence", _transitions, "run string, sequence long, legal boolean, state string")
