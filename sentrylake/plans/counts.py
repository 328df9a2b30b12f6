"""Counts, histograms, time lines and roll-ups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as C
from ..operators.upserts import appended
from .analogues import query


@query("SELECT count(*) AS n FROM items WHERE status = 'active' AND item_type = 'vulnerability' AND EXISTS (SELECT 1 FROM records WHERE item_id = items.id AND source = 's20')")
def a01_total(t):
    from ..operators.joins import having

    return having(C.of_type(C.active(t.items), None), "id", t.records.where("source = 's20'"), "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (status = 'active') AS active_items, count(*) FILTER (status = 'active' AND item_type <> 'vulnerability') AS active_articles,
 count(*) FILTER (status = 'active' AND item_type = 'vulnerability' AND severity = 'critical') AS critical, count(*) FILTER (status = 'active' AND item_type = 'vulnerability' AND severity = 'high') AS high,
 count(*) FILTER (status = 'active' AND item_type = 'vulnerability' AND kev_status = 'listed') AS listed, count(*) FILTER (status = 'active' AND item_type = 'vulnerability' AND epss >= 0.7) AS likely_exploited,
 count(*) FILTER (status = 'active' AND relevance IN ('confirmed','probable')) AS relevant, count(*) FILTER (status = 'active' AND collected >= TIMESTAMP '1998-01-01' AND collected < TIMESTAMP '1998-01-31') AS collected_in_window FROM items""")
def a02_a05_dashboard(t):
    return A.dashboard_counts(t.items, datetime(1998, 1, 1), datetime(1998, 1, 31))


def _one(name: str, column: str, sql: str):
    def f(t):
        return A.dashboard_counts(t.items, datetime(1998, 1, 1), datetime(1998, 1, 31)).select(column)

    f.__name__ = name
    return query(f"SELECT count(*) AS {column} FROM items WHERE status = 'active' AND {sql}")(f)


_one("a02_active_articles", "active_articles", "item_type <> 'vulnerability'")
_one("a03_critical", "critical", "item_type = 'vulnerability' AND severity = 'critical'")
_one("a03_likely_exploited", "likely_exploited", "item_type = 'vulnerability' AND epss >= 0.7")
_one("a04_relevant", "relevant", "relevance IN ('confirmed','probable')")
_one("a05_collected_in_window", "collected_in_window", "collected >= TIMESTAMP '1998-01-01' AND collected < TIMESTAMP '1998-01-31'")


@query("SELECT max(finished) AS latest FROM runs WHERE status = 'success'")
def a06_latest_success(t):
    return t.runs.where("status = 'success'").agg(F.max("finished").alias("latest"))


@query("SELECT status, count(*) AS n FROM runs GROUP BY status")
def a07_status_map(t):
    return A.status_map(t.runs, "status").select(F.explode("counts").alias("status", "n"))


@query("SELECT count(DISTINCT cycle) FILTER (status = 'running') AS cycles, count(*) FILTER (status = 'running') AS runs, count(DISTINCT source) FILTER (status = 'failed') AS attention FROM runs")
def a08_active(t):
    return t.runs.agg(F.count_distinct(F.when(F.col("status") == "running", F.col("cycle"))).alias("cycles"), F.count_if(F.col("status") == "running").alias("runs"), F.count_distinct(F.when(F.col("status") == "failed", F.col("source"))).alias("attention"))


@query("SELECT source, max(attempt) AS attempt FROM runs GROUP BY source")
def a09_highest_attempt(t):
    return t.runs.groupBy("source").agg(F.max("attempt").alias("attempt"))


@query("WITH m AS (SELECT run, max(sequence) AS last FROM turns GROUP BY run) SELECT e.cycle, e.id, coalesce(last, 0) + row_number() OVER (PARTITION BY e.cycle ORDER BY e.id) AS sequence FROM runs e LEFT JOIN m ON e.cycle = m.run")
def a10_appended_sequence(t):
    return appended(t.runs.select("cycle", "id"), t.turns.select(F.col("run").alias("cycle"), "sequence"), "cycle", "id").select("cycle", "id", "sequence")


@query("SELECT id, (SELECT count(*) FROM records r WHERE r.indicator_id = n.id) AS provenances, (SELECT count(*) FROM records r JOIN items i ON r.item_id = i.id WHERE r.indicator_id = n.id AND i.status = 'active') AS publications FROM indicators n")
def a11_indicator_counts(t):
    on = t.records.join(t.items.where("status = 'active'").select(F.col("id").alias("item_id")), "item_id")
    return A.grouped_counts(t.indicators.select("id"), "id", provenances=(t.records, "indicator_id"), publications=(on, "indicator_id"))


_ROLL = "SELECT cycle, count(*) AS started, count(*) FILTER (status <> 'running') AS completed, count(*) FILTER (status IN ('success','no_change')) AS successful, count(*) FILTER (status IN ('partial','failed')) AS unsuccessful FROM runs GROUP BY cycle"


@query(f"SELECT *, CASE WHEN completed < started THEN 'running' WHEN unsuccessful = 0 THEN 'success' WHEN successful > 0 THEN 'partial' ELSE 'failed' END AS cycle_status FROM ({_ROLL})")
def a12_cycle_rollup(t):
    return A.cycle_rollup(t.runs, "cycle", "status", ["success", "no_change", "partial", "failed"], ["success", "no_change"])


@query("""WITH c AS (SELECT source, count(*) AS total, count(*) FILTER (flag = 'created') AS created, count(*) FILTER (flag = 'updated') AS updated, count(*) FILTER (flag = 'skipped') AS skipped, count(*) FILTER (flag = 'failed') AS failed
 FROM (SELECT source_id AS source, CASE WHEN flag = 'A' THEN 'created' WHEN flag = 'R' THEN 'updated' WHEN indicator_id % 50 = 0 THEN 'failed' ELSE 'unchanged' END AS flag FROM records) GROUP BY 1)
 SELECT *, CASE WHEN failed = total AND total > 0 THEN 'failed' WHEN failed + skipped > 0 THEN 'partial' WHEN created + updated = 0 THEN 'no_change' ELSE 'success' END AS status FROM c""")
def a13_outcome_counters(t):
    flag = F.when(F.col("flag") == "A", "created").when(F.col("flag") == "R", "updated").when(F.col("indicator_id") % 50 == 0, "failed").otherwise("unchanged")
    c = A.outcome_counters(t.records.select(F.col("source_id").alias("source"), flag.alias("flag")), ["source"], "flag", ["created", "updated", "skipped", "failed"])
    return c.withColumn("status", A.run_status(*(F.col(x) for x in ("created", "updated", "skipped", "failed", "total"))))


@query("SELECT count(*) AS total, count(*) FILTER (flag = 'A') AS a, count(*) FILTER (flag = 'N') AS n, count(*) FILTER (flag = 'R') AS r FROM records")
def a14_batch_counters(t):
    return A.outcome_counters(t.records, [], "flag", ["A", "N", "R"]).toDF("total", "a", "n", "r")


@query("SELECT CASE WHEN last IS NULL THEN 'never' WHEN TIMESTAMP '2024-01-30 12:00:00' - last <= INTERVAL 4 HOUR THEN 'fresh' ELSE 'stale' END AS freshness, count(*) AS n FROM (SELECT people.id, max(finished) AS last FROM people LEFT JOIN runs ON runs.source = people.id GROUP BY 1) GROUP BY 1")
def a15_freshness_histogram(t):
    last = t.runs.groupBy(F.col("source").alias("id")).agg(F.max("finished").alias("last"))
    fresh = C.freshness(F.expr("timestamp_ntz'2024-01-30 12:00:00'"), "last", F.lit(True))
    return t.people.select("id").join(last, "id", "left").groupBy(fresh.alias("freshness")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS failures FROM runs WHERE status = 'failed' AND started >= TIMESTAMP '2024-01-10 11:45:00' AND started < TIMESTAMP '2024-01-10 12:00:00'")
def a16_recent_failures(t):
    return C.history(t.runs, "started", datetime(2024, 1, 10, 11, 45), datetime(2024, 1, 10, 12), 1, status="failed").agg(F.count(F.lit(1)).alias("failures"))


_SAMPLE = "s AS (SELECT * FROM items WHERE status = 'active' ORDER BY published DESC NULLS LAST, id DESC LIMIT 100)"


@query(f"WITH {_SAMPLE} SELECT v.severity, CAST(v.place AS INT) AS place, count(s.id) AS n FROM (VALUES ('critical',0),('high',1),('medium',2),('low',3),('none',4),('unknown',5)) v(severity, place) LEFT JOIN s ON coalesce(s.severity,'unknown') = v.severity GROUP BY 1, 2")
def a17_severity_zero_fill(t):
    from ..operators.paging import orders

    sample = C.active(t.items).orderBy(*orders("newest_published")).limit(100)
    return A.zero_filled(sample, "severity", ["critical", "high", "medium", "low", "none", "unknown"], "unknown")


@query(f"WITH {_SAMPLE} SELECT v.item_type, CAST(v.place AS INT) AS place, count(s.id) AS n FROM (VALUES ('vulnerability',0),('advisory',1),('news',2),('report',3),('official_alert',4),('guide',5),('podcast',6)) v(item_type, place) LEFT JOIN s ON s.item_type = v.item_type GROUP BY 1, 2")
def a18_category_zero_fill(t):
    from ..operators.paging import orders

    sample = C.active(t.items).orderBy(*orders("newest_published")).limit(100)
    return A.zero_filled(sample, "item_type", [*C.ITEM_TYPES, "podcast"], "unknown")


@query("SELECT CAST(moment AS DATE) AS day, count(*) FILTER (s = 1) AS first, count(*) FILTER (s = 2) AS second FROM (SELECT started AS moment, 1 AS s FROM runs WHERE status = 'success' UNION ALL SELECT finished, 2 FROM runs WHERE status = 'failed') WHERE moment IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def a19_timeline(t):
    return A.daily_timeline(t.runs.where("status = 'success'").withColumn("at", F.col("started")), t.runs.where("status = 'failed'").withColumn("at", F.col("finished")), "at")


@query("SELECT relevance, scope, count(*) AS n FROM items GROUP BY 1, 2")
def a20_rule_histogram(t):
    return t.items.groupBy("relevance", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, max(greatest(started, coalesce(finished, started))) AS newest FROM runs GROUP BY 1")
def a21_greatest_time(t):
    return t.runs.groupBy("source").agg(F.max(F.greatest("started", "finished")).alias("newest"))


@query("SELECT id, CASE WHEN balance / 10000 >= 0.95 THEN 'critical' WHEN balance / 10000 >= 0.85 THEN 'warning' ELSE 'healthy' END AS level FROM people")
def a22_storage_level(t):
    return t.people.select("id", A.storage_level(F.col("balance"), F.lit(10000)).alias("level"))


@query("SELECT CASE max(CASE level WHEN 'healthy' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) WHEN 1 THEN 'healthy' WHEN 2 THEN 'warning' ELSE 'critical' END AS overall FROM (SELECT CASE WHEN balance >= 9500 THEN 'critical' WHEN balance >= 8500 THEN 'warning' ELSE 'healthy' END AS level FROM sources)")
def a23_overall(t):
    return A.worst(t.sources.withColumn("level", A.storage_level(F.col("balance"), F.lit(10000))), "level", ["healthy", "warning", "critical"])


@query("SELECT source, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS value FROM runs GROUP BY source")
def a24_percentile(t):
    return A.percentile_by_index(t.runs, ["source"], "value", 0.95)
