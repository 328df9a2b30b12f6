"""Progress, limits and windows. Stateful streams are tested against these finished tables."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..sources import pages
from ..streaming import handler
from ..streaming import progress as G
from ..streaming import throttle as T
from .analogues import query, shared_folder


@query("SELECT id, started FROM runs WHERE started >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 MINUTE")
def t01_since_watermark(t):
    return G.since(t.runs.select("id", "started"), "started", F.expr("timestamp_ntz'2024-01-20 12:00:00'"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS place FROM people")
def t02_resumed_cursor(t):
    h = F.sha2(F.col("name"), 256)
    token = G.cursor(F.when(F.col("id") % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(h), F.col("id"))
    return t.people.select("id", G.resumed(token, h).alias("place"))


@query("SELECT source, cycle, CASE WHEN count(*) FILTER (status NOT IN ('success','no_change')) = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS watermark FROM runs GROUP BY source, cycle")
def t03_next_watermark(t):
    slot, previous = F.expr("timestamp_ntz'2024-02-01 00:00:00'"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return G.next_watermark(t.runs, "status", slot, previous, ("source", "cycle"))


@query("SELECT id, source, status FROM runs")
def t03_recovered_handler(t):
    # the source's pages; the handler is lost between the data and the progress of its first run, and comes again
    root, schema = shared_folder(t, "handler"), "id long, source long, status string"
    page = F.floor(F.col("id") / 2000)
    t.runs.select("id", "source", "status", page.alias("page")).repartition("page").write.partitionBy("page").json(f"{root}/pages")

    def lost(number):
        raise RuntimeError("lost")

    for between in (lost, lambda number: None):
        stream = pages.page_stream(t.spark, f"{root}/pages", schema)
        run = stream.writeStream.foreachBatch(handler.source_handler(root, "id", between)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        try:
            run.start().awaitTermination()
        except StreamingQueryException:
            if handler.progress_of(t.spark, root) is not None:
                raise RuntimeError("a lost run has made progress") from None
    done = handler.handled(t.spark, root, schema)
    if handler.progress_of(t.spark, root) != done.agg(F.max("id")).first()[0]:
        raise RuntimeError("the progress is not that of the data")
    return done


@query("SELECT id, status FROM runs")
def t03_exactly_once(t):
    # two batches, each tried again after it was written
    root = shared_folder(t, "once")
    write = G.once(lambda df, n: df.write.mode("append").parquet(f"{root}/data"), f"{root}/log")
    for number, part in enumerate((t.runs.where("attempt < 2"), t.runs.where("attempt >= 2"))):
        for _ in range(2):
            write(part.select("id", "status"), number)
    return t.spark.read.schema("id long, status string").parquet(f"{root}/data")


@query("SELECT source, CASE WHEN source IN ('src3', 'src7') OR count(*) FILTER (n_chars < 20) > 0 THEN 'process' ELSE 'no_change' END AS outcome FROM publications GROUP BY source")
def t04_no_change(t):
    # what was stored is the state before two sources changed one text each
    now = G.feed_digests(t.publications, "source", "id", "text")
    first = t.publications.groupBy("source").agg(F.min("id").alias("id")).where("source in ('src3', 'src7')").withColumn("old", F.lit(True))
    before = t.publications.join(F.broadcast(first), ["source", "id"], "left").withColumn("text", F.when(F.col("old"), "before").otherwise(F.col("text")))
    rejected = t.publications.groupBy("source").agg(F.count_if(F.col("n_chars") < 20).alias("rejected"))
    return G.feed_changes(now.join(rejected, "source"), G.feed_digests(before, "source", "id", "text"))


@query("SELECT id, source FROM publications WHERE source IN ('src3', 'src7')")
def t04_short_circuit(t):
    root = shared_folder(t, "changed")
    changes = t.publications.select("source").distinct().withColumn("outcome", F.when(F.col("source").isin("src3", "src7"), "process").otherwise("no_change"))
    entries = t.publications.select("id", "source")
    G.write_changed(entries, changes, "source", root)
    if G.write_changed(entries, changes.where("outcome = 'no_change'"), "source", root):
        raise RuntimeError("sources without a change were written")
    return t.spark.read.schema(entries.schema).parquet(root)


@query("SELECT id, (SELECT count(*) FROM runs b WHERE b.source = a.source AND b.started <= a.started AND b.started > a.started - INTERVAL 12 HOUR) AS recent FROM runs a")
def t05_sliding_limit(t):
    return T.recent(t.runs.select("id", "source", "started"), ["source"], "started", 12 * 3600, "id").select("id", "recent")


@query("""WITH RECURSIVE r AS (SELECT id, source, started, row_number() OVER (PARTITION BY source ORDER BY started, id) AS n FROM runs),
f AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS TIMESTAMP[]) AS passed, false AS admitted FROM (SELECT DISTINCT source FROM r)
UNION ALL SELECT source, n, id, CASE WHEN len(kept) < 2 THEN list_append(kept, started) ELSE kept END, len(kept) < 2 FROM (SELECT r.source, r.n, r.id, r.started, list_filter(f.passed, lambda x: x > r.started - INTERVAL 2 DAY) AS kept FROM f JOIN r ON r.source = f.source AND r.n = f.n + 1))
SELECT id, admitted FROM f WHERE n > 0""")
def t05_admissions(t):
    return T.admissions(t.runs.select("id", "source", "started"), ["source"], "started", 2 * 86_400, 2, "id", 4).select("id", "admitted")


@query("""WITH RECURSIVE e AS (SELECT CAST(source AS VARCHAR) AS key, started AS born FROM runs WHERE status = 'failed'),
w AS (SELECT key, min(born) AS begun FROM e GROUP BY key UNION ALL SELECT key, begun FROM (SELECT w.key, (SELECT min(born) FROM e WHERE e.key = w.key AND e.born >= w.begun + INTERVAL 1 DAY) AS begun FROM w) WHERE begun IS NOT NULL),
p AS (SELECT key, born, row_number() OVER (PARTITION BY key, begun ORDER BY born) AS failures FROM (SELECT e.key, e.born, max(w.begun) AS begun FROM (SELECT key, born, row_number() OVER () AS i FROM e) e JOIN w ON w.key = e.key AND w.begun <= e.born GROUP BY e.key, e.born, e.i))
SELECT key, born AS failed, failures, EXISTS (SELECT 1 FROM p q WHERE q.key = p.key AND q.failures >= 3 AND (q.born, q.failures) <= (p.born, p.failures) AND p.born < q.born + INTERVAL 1 HOUR) AS blocked FROM p""")
def t06_failure_windows(t):
    f = t.runs.where("status = 'failed'")
    return T.failure_batch(f, "source", "started", 86_400, 3, 3600).select("key", F.to_timestamp_ntz(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("failed"), "failures", "blocked")


@query("SELECT id, CASE WHEN hour(started) % 2 = 0 AND id % 3 > 0 THEN date_trunc('hour', started) + INTERVAL 17 MINUTE END AS slot, least(source * 5, 300) AS delay FROM runs")
def t07_schedule(t):
    minute = F.when(F.col("id") % 3 > 0, F.expr("interval 17 minutes")).otherwise(F.expr("interval 16 minutes"))
    at = F.date_trunc("hour", "started").cast("timestamp_ntz") + minute
    return G.schedule(t.runs.select("id", "source", at.alias("at")), "at", "source").select("id", "slot", "delay")


@query("SELECT id, CASE WHEN status IN ('failed', 'partial') AND attempt < 3 THEN CASE WHEN attempt <= 1 THEN 30 ELSE 60 END END AS delay FROM runs")
def t08_retry_delay(t):
    return t.runs.select("id", G.retry_delay("attempt", F.col("status").isin("failed", "partial")).alias("delay"))


@query("SELECT cycle, arg_max(status, (started, id)) AS status, count(*) AS events FROM runs GROUP BY cycle")
def t09_status_fold(t):
    return t.runs.groupBy("cycle").agg(F.max_by("status", F.struct("started", "id")).alias("status"), F.count(F.lit(1)).alias("events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, started) AS hour, status, count(*) AS n FROM runs GROUP BY 1, 2")
def t10_tumbling(t):
    return T.bucketed(t.runs, "started", "1 hour", "status").select(F.col("window.start").alias("hour"), "status", F.col("count").alias("n"))


@query("SELECT id, CASE WHEN id % 4 = 0 OR id % 3 = 0 THEN NULL ELSE '2024-02-01' END AS cursor FROM people")
def t11_server_cursor(t):
    offered = F.when(F.col("id") % 4 == 0, "2024-01-01").otherwise("2024-02-01")
    return t.people.select("id", G.server_cursor(F.lit("2024-01-01"), offered, F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("cursor"))
