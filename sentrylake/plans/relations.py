"""Join shapes over the simulated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .analogues import query

_PICK = "SELECT item_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS n FROM {table}) WHERE n = 1"


@query("SELECT items.id, quality FROM items JOIN marks ON items.id = marks.id")
def j01_one_to_one(t):
    return t.items.join(t.marks, "id").select("id", "quality")


@query("SELECT i.id, r.record_id, s.slug FROM items i JOIN records r ON i.id = r.item_id AND i.created < r.seen JOIN sources s ON r.source_id = s.id")
def j02_composite(t):
    i, r = t.items.select("id", "created"), t.records.select("item_id", "record_id", "seen", "source_id")
    s = t.sources.select(F.col("id").alias("source_id"), "slug")
    return i.join(r, (i["id"] == r["item_id"]) & (i["created"] < r["seen"])).join(s, "source_id").select("id", "record_id", "slug")


@query("SELECT r.id, p.name FROM runs r JOIN people p ON r.source = p.id")
def j03_run_source(t):
    return t.runs.join(t.people.select(F.col("id").alias("source"), "name"), "source").select("id", "name")


@query("SELECT n.id, s.slug, r.record_id FROM indicators n JOIN sources s ON n.id = s.id LEFT JOIN records r ON r.indicator_id = n.id AND r.source_id = s.id")
def j04_left_composite(t):
    base = t.indicators.select("id").join(t.sources.select("id", "slug"), "id")
    r = t.records.select("record_id", "indicator_id", "source_id")
    return base.join(r, (r["indicator_id"] == base["id"]) & (r["source_id"] == base["id"]), "left").select("id", "slug", "record_id")


@query("SELECT r.item_id, n.value, count(*) AS n FROM records r JOIN indicators n ON r.indicator_id = n.id JOIN items i ON r.item_id = i.id WHERE i.status = 'active' GROUP BY 1, 2")
def j05_bridge(t):
    b = t.records.select("item_id", F.col("indicator_id").alias("id")).join(t.indicators.select("id", "value"), "id")
    return b.join(t.items.where("status = 'active'").select(F.col("id").alias("item_id")), "item_id").groupBy("item_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query(_PICK.format(table="records", order="NOT is_primary, coalesce(source,''), coalesce(external_id,''), url, seen, record_id"))
def j06_primary_record_pick(t):
    return J.primary_record(t.records).select("item_id", "record_id")


@query(_PICK.format(table="records", order="NOT is_primary, source NULLS FIRST, seen, record_id"))
def j07_primary_by_creation(t):
    return J.primary_by_creation(t.records).select("item_id", "record_id")


@query("SELECT item_id, value AS identifier, CASE WHEN namespace = 'cve' THEN value END AS cve_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY NOT is_primary, value) AS n FROM identifiers WHERE is_primary OR namespace = 'cve') WHERE n = 1")
def j08_primary_identifier(t):
    # equal values have one namespace here, so the pick is total
    p = J.primary_identifier(t.identifiers)
    return p.select("item_id", F.col("value").alias("identifier"), F.when(F.col("namespace") == "cve", F.col("value")).alias("cve_id"))


@query("SELECT id FROM items WHERE EXISTS (SELECT 1 FROM records WHERE item_id = items.id AND source = 's20')")
def j09_having_source(t):
    return J.having(t.items, "id", t.records.where("source = 's20'"), "item_id").select("id")


@query("SELECT id FROM runs WHERE EXISTS (SELECT 1 FROM errors WHERE run_id = runs.id AND retryable AND event_type = 'error')")
def j10_retryable(t):
    return J.having(t.runs, "id", t.errors.where("retryable and event_type = 'error'"), "run_id").select("id")


@query("SELECT id FROM runs WHERE NOT EXISTS (SELECT 1 FROM errors WHERE run_id = runs.id AND retryable AND event_type = 'error')")
def j10_not_retryable(t):
    return J.lacking(t.runs, "id", t.errors.where("retryable and event_type = 'error'"), "run_id").select("id")


@query("SELECT id, EXISTS (SELECT 1 FROM items WHERE owner = people.id) AS has_items, EXISTS (SELECT 1 FROM runs WHERE source = people.id) AS has_runs, EXISTS (SELECT 1 FROM errors WHERE run_id = people.id AND event_type = 'error') AS has_errors FROM people")
def j11_projected_flags(t):
    return J.flagged(t.people, "id", has_items=(t.items, "owner"), has_runs=(t.runs, "source"), has_errors=(t.errors.where("event_type = 'error'"), "run_id")).select("id", "has_items", "has_runs", "has_errors")


@query("SELECT s.id, CASE WHEN e.source = s.id THEN e.target ELSE e.source END AS other, CASE WHEN e.source = s.id THEN 'outgoing' ELSE 'incoming' END AS direction FROM sources s JOIN edges e ON e.source = s.id OR e.target = s.id")
def j12_neighbours(t):
    return J.neighbours(t.sources, t.edges)


@query("SELECT r.id, r.source, r.attempt FROM runs r JOIN (SELECT source, cycle, max(attempt) AS a FROM runs GROUP BY 1, 2) m ON r.source = m.source AND r.cycle = m.cycle AND r.attempt = m.a")
def j13_newest_attempts(t):
    return J.newest_attempts(t.runs, ["source", "cycle"]).select("id", "source", "attempt")


@query("SELECT i.id, (SELECT max(seen) FROM records r WHERE r.item_id = i.id AND r.flag = 'R') AS scored FROM items i WHERE item_type = 'vulnerability' ORDER BY scored ASC NULLS FIRST, id LIMIT 500")
def j14_scored_candidates(t):
    last = t.records.where("flag = 'R'").groupBy(F.col("item_id").alias("id")).agg(F.max("seen").alias("scored"))
    from ..operators.paging import fair_candidates

    return fair_candidates(t.items.where("item_type = 'vulnerability'").select("id").join(last, "id", "left"), "scored", "id")


@query("SELECT DISTINCT value FROM identifiers WHERE value IN (SELECT concat('CVE-2099-', CAST(10000 + id AS VARCHAR)) FROM indicators WHERE status = 'active')")
def j15_catalog_known(t):
    c = t.indicators.where("status = 'active'").select(F.concat(F.lit("CVE-2099-"), (10000 + F.col("id")).cast("string")).alias("value"))
    return J.having(t.identifiers, "value", c, "value").select("value").distinct()


@query("WITH r AS (SELECT item_id, record_id, row_number() OVER (PARTITION BY item_id ORDER BY record_id) AS n FROM records), l AS (SELECT item_id, string_agg(record_id, ',' ORDER BY record_id) AS ids FROM r WHERE n <= 4 GROUP BY 1) SELECT id, ids FROM items LEFT JOIN l ON id = item_id")
def j16_children(t):
    c = J.children(t.items.select("id"), "id", t.records.select("item_id", "record_id"), "item_id", ["record_id"], ["record_id"], "children", 4)
    return c.select("id", F.array_join(F.transform("children", lambda x: x["record_id"]), ",").alias("ids"))


@query("SELECT p.id, n.n_name AS role, r.r_name AS region, count(*) AS sessions FROM people p JOIN nation n ON p.nation = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN runs e ON e.source = p.id GROUP BY 1, 2, 3")
def j17_identity_chain(t):
    n = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("role"), F.col("r_name").alias("region"))
    sessions = t.runs.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("sessions"))
    return t.people.join(sessions, "id").join(n, "nation").select("id", "role", "region", "sessions")
