"""Set operations and upserts."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import ordered as B
from ..operators import sets as X
from ..operators import upserts as U
from ..sources import sinks
from .analogues import query, shared_folder


@query("SELECT 'run' AS category, id FROM runs WHERE status = 'failed' UNION ALL SELECT 'item', id FROM items WHERE status = 'archived' UNION ALL SELECT 'turn', run FROM turns")
def x01_union(t):
    part = lambda df, name, key: df.select(F.lit(name).alias("category"), F.col(key).alias("id"))
    return X.union_all([part(t.runs.where("status = 'failed'"), "run", "id"), part(t.items.where("status = 'archived'"), "item", "id"), part(t.turns, "turn", "run")])


@query("SELECT id, CASE WHEN id IN (SELECT indicator_id FROM records WHERE flag = 'R' AND source_id < 10) THEN 'listed' ELSE 'not_listed' END AS catalog_status FROM indicators")
def x02_membership(t):
    return X.membership(t.indicators.select("id"), "id", t.records.where("flag = 'R' and source_id < 10"), "indicator_id")


@query("SELECT id FROM people EXCEPT SELECT owner FROM items EXCEPT SELECT source FROM runs")
def x03_unanswered(t):
    return X.unanswered(t.people.select("id"), t.items.select(F.col("owner").alias("id")), t.runs.select(F.col("source").alias("id")), "id")


_REC = "SELECT {k}, CASE WHEN e.id IS NULL THEN 'create' {p} WHEN d.id IS NULL THEN 'delete' WHEN e.v IS NOT DISTINCT FROM d.v THEN 'unchanged' ELSE 'update' END AS action FROM e FULL JOIN d ON e.id = d.id"


@query("WITH e AS (SELECT id, kind AS v FROM indicators WHERE status = 'active'), d AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'NEW' ELSE kind END AS v FROM indicators WHERE NOT revoked) " + _REC.format(k="coalesce(e.id, d.id) AS id", p=""))
def x04_reconciled(t):
    e = t.indicators.where("status = 'active'").select("id", F.col("kind").alias("v"))
    d = t.indicators.where("not revoked").select("id", F.when(F.col("id") % 5 == 0, "NEW").otherwise(F.col("kind")).alias("v"))
    return X.reconciled(e, d, ["id"], "v")


@query("WITH e AS (SELECT id, kind AS v, id % 10 = 1 AS manual FROM indicators WHERE status = 'active'), d AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'NEW' ELSE kind END AS v FROM indicators WHERE NOT revoked) " + _REC.format(k="coalesce(e.id, d.id) AS id", p="WHEN e.manual THEN 'protected'"))
def x05_reconciled_protected(t):
    e = t.indicators.where("status = 'active'").select("id", F.col("kind").alias("v"))
    d = t.indicators.where("not revoked").select("id", F.when(F.col("id") % 5 == 0, "NEW").otherwise(F.col("kind")).alias("v"))
    return X.reconciled(e, d, ["id"], "v", F.col("id") % 10 == 1)


_DOCS = "d AS (SELECT id, source, sha256(text) AS h FROM publications)"


@query(f"WITH {_DOCS} SELECT h, arg_min(source, id) AS source, min(id) AS first, count(*) AS members, count(DISTINCT source) > 1 AS conflict FROM d GROUP BY h")
def x06_first_or_conflict(t):
    d = t.publications.select("id", "source", F.sha2("text", 256).alias("h"))
    return X.first_or_conflict(d, ["h"], "source", "id")


@query(f"WITH {_DOCS} SELECT id, h FROM d WHERE h IN (SELECT h FROM d GROUP BY h HAVING count(DISTINCT source) = 1)")
def x07_without_conflicts(t):
    d = t.publications.select("id", "source", F.sha2("text", 256).alias("h"))
    return X.without_conflicts(d, ["h"], "source").select("id", "h")


# Batches of 100 rows in the order of their ids; the SQL reads them row by row, with what was accepted in a list.
@query("""WITH RECURSIVE r AS (SELECT id, id // 100 AS b, row_number() OVER (PARTITION BY id // 100 ORDER BY id) AS n, source % 40 AS e, (source * 7 + attempt) % 45 AS u, status AS c FROM runs),
f AS (SELECT b, n, id, [{'e': e, 'u': u, 'c': c}] AS acc, 'accepted' AS identity FROM r WHERE n = 1
UNION ALL SELECT b, n, id, CASE WHEN x = 'accepted' THEN list_append(acc, {'e': e, 'u': u, 'c': c}) ELSE acc END, x FROM (SELECT r.*, f.acc, CASE WHEN len(list_filter(f.acc, lambda a: a.e = r.e OR a.u = r.u)) = 0 THEN 'accepted' WHEN list_contains(f.acc, {'e': r.e, 'u': r.u, 'c': r.c}) THEN 'duplicate' ELSE 'conflict' END AS x FROM f JOIN r ON r.b = f.b AND r.n = f.n + 1))
SELECT id, identity FROM f""")
def x08_accepted_in_order(t):
    r = t.runs.select("id", F.expr("id div 100").alias("b"), (F.col("source") % 40).alias("e"), ((F.col("source") * 7 + F.col("attempt")) % 45).alias("u"), "status")
    return B.accepted_in_order(r, "b", "id", "e", "u", "status").select(F.col("place").alias("id"), "identity")


@query("SELECT * FROM (VALUES (1, 'b,a,c')) v(id, x)")
def x09_ordered_unique(t):
    df = t.spark.createDataFrame([(1, ["b", "a", "b", "c", "a"])], "id int, x array<string>")
    return df.select("id", F.array_join(X.ordered_unique("x"), ",").alias("x"))


@query("""WITH q AS (SELECT DISTINCT id AS k FROM indicators WHERE status = 'active'), r AS (SELECT indicator_id AS k, count(DISTINCT flag) AS c, min(CASE WHEN source_id > 2 THEN 1 ELSE 0 END) AS ok FROM records WHERE flag <> 'N' GROUP BY 1)
SELECT coalesce(q.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'unchanged' WHEN q.k IS NULL THEN 'unknown' WHEN ok = 0 THEN 'invalid' WHEN c > 1 THEN 'conflict' ELSE 'matched' END AS outcome FROM q FULL JOIN r ON q.k = r.k""")
def x10_matched_responses(t):
    q = t.indicators.where("status = 'active'").select(F.col("id").alias("k"))
    r = t.records.where("flag <> 'N'").select(F.col("indicator_id").alias("k"), "flag", "source_id")
    return X.matched_responses(q, r, "k", "flag", F.col("source_id") > 2)


_BATCHES = "SELECT id, id // 100 AS b, row_number() OVER (PARTITION BY id // 100 ORDER BY id) AS n, concat('e', CAST(id // 100 * 100 + id % 37 % 30 AS VARCHAR)) AS e, concat('u', CAST(id // 100 * 100 + id % 37 * 5 % 31 AS VARCHAR)) AS u, segment AS c FROM people"


def _batches(t):
    b, k = F.expr("id div 100"), F.col("id") % 37
    name = lambda p, x: F.concat(F.lit(p), (b * 100 + x).cast("string"))
    return t.people.select(b.alias("batch"), F.col("id").alias("place"), name("e", k % 30).alias("external_id"), name("u", k * 5 % 31).alias("url_hash"), F.col("segment").alias("content_hash"))


@query(f"""WITH RECURSIVE r AS ({_BATCHES}), c AS (SELECT CAST(id AS VARCHAR) AS id, concat('e', CAST(id AS VARCHAR)) AS e, concat('u', CAST(id AS VARCHAR)) AS u, kind AS c FROM indicators WHERE id % 4 < 3),
z AS (SELECT r.b, list_distinct(list({{'id': c.id, 'e': c.e, 'u': c.u, 'c': c.c}})) AS recs FROM r JOIN c ON c.e = r.e OR c.u = r.u GROUP BY r.b),
f AS (SELECT DISTINCT r.b, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, coalesce(z.recs, []) AS recs, 0 AS made, CAST(NULL AS VARCHAR) AS record, CAST(NULL AS VARCHAR) AS outcome FROM r LEFT JOIN z ON r.b = z.b
UNION ALL SELECT b, n, id, CASE WHEN x IN ('failed', 'unchanged') THEN recs ELSE list_append(list_filter(recs, lambda y: y.id <> k), {{'id': k, 'e': e, 'u': u, 'c': c}}) END, CASE WHEN x = 'created' THEN made + 1 ELSE made END, k, x
FROM (SELECT b, n, id, e, u, c, recs, made, CASE WHEN ra.id IS NOT NULL AND rb.id IS NOT NULL AND ra.id <> rb.id THEN 'failed' WHEN ra.id IS NULL AND rb.id IS NULL THEN 'created' WHEN coalesce(ra.c, rb.c) = c THEN 'unchanged' ELSE 'updated' END AS x, coalesce(ra.id, rb.id, concat('new:', CAST(made + 1 AS VARCHAR))) AS k
FROM (SELECT r.*, f.recs, f.made, list_filter(f.recs, lambda y: y.e = r.e)[1] AS ra, list_filter(f.recs, lambda y: y.u = r.u)[1] AS rb FROM f JOIN r ON r.b = f.b AND r.n = f.n + 1)))
SELECT id, record, outcome FROM f WHERE n > 0""")
def u01_publication_upsert(t):
    name = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    cur = t.indicators.where("id % 4 < 3").select("id", name("e").alias("external_id"), name("u").alias("url_hash"), F.col("kind").alias("content_hash"))
    return B.publication_outcomes(cur, _batches(t)).select(F.col("place").alias("id"), "record", "outcome")


_FEED = "SELECT id, id // 100 AS b, row_number() OVER (PARTITION BY id // 100 ORDER BY id) AS n, concat('s', CAST(id % 2 AS VARCHAR)) AS s, concat('e', CAST(id // 100 * 100 + id % 37 % 30 AS VARCHAR)) AS e, concat('u', CAST(id // 100 * 100 + id % 37 * 5 % 31 AS VARCHAR)) AS u, concat('t', CAST(id // 100 * 100 + id % 41 * 3 % 29 AS VARCHAR)) AS t, segment AS c, CASE WHEN id % 19 = 0 THEN 'news' ELSE 'advisory' END AS k FROM people"


def _feed(t):
    b = F.expr("id div 100")
    name = lambda p, x: F.concat(F.lit(p), (b * 100 + x).cast("string"))
    k = F.col("id") % 37
    return t.people.select(
        F.col("id").alias("place"),
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"),
        name("e", k % 30).alias("external_id"),
        name("u", k * 5 % 31).alias("url_hash"),
        name("t", F.col("id") % 41 * 3 % 29).alias("title_hash"),
        F.col("segment").alias("content_hash"),
        F.when(F.col("id") % 19 == 0, "news").otherwise("advisory").alias("item_type"),
    )


# keys of one hundred ids never meet those of another, so the SQL may fold hundreds side by side; the operator finds its groups itself
_JOINT = f"""WITH RECURSIVE r AS ({_FEED}),
rs AS (SELECT id // 100 AS b, list({{'i': concat('r', CAST(id AS VARCHAR)), 's': concat('s', CAST(id % 2 AS VARCHAR)), 'e': concat('e', CAST(id AS VARCHAR)), 'u': concat('u', CAST(id AS VARCHAR)), 'c': kind, 't': CASE WHEN id % 23 > 0 THEN concat('i', CAST(id - id % 100 % 3 AS VARCHAR)) END}} ORDER BY id) AS v FROM indicators WHERE id % 4 = 0 GROUP BY 1),
its AS (SELECT id // 100 AS b, list({{'i': concat('i', CAST(id AS VARCHAR)), 'k': CASE WHEN id % 8 = 0 THEN 'news' ELSE 'advisory' END, 'a': status = 'active'}}) AS v FROM indicators GROUP BY 1),
nms AS (SELECT id // 100 AS b, list({{'n': CASE WHEN id % 2 = 0 THEN 'url' ELSE 'title' END, 'v': concat(CASE WHEN id % 2 = 0 THEN 'u' ELSE 't' END, CAST(id AS VARCHAR)), 'i': concat('i', CAST(id - id % 100 % 3 AS VARCHAR))}}) AS v FROM indicators WHERE id % 5 < 2 GROUP BY 1),
f AS (SELECT b, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, coalesce(rs.v, []) AS recs, coalesce(its.v, []) AS items, coalesce(nms.v, []) AS names, CAST(NULL AS VARCHAR) AS record, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT b FROM r) LEFT JOIN rs USING (b) LEFT JOIN its USING (b) LEFT JOIN nms USING (b)
UNION ALL SELECT b, n, id,
CASE WHEN x = 'updated' THEN list_append(list_filter(recs, lambda y: y.i <> record), {{'i': record, 's': s, 'e': e, 'u': u, 'c': c, 't': item}}) WHEN x IN ('created', 'linked') THEN list_append(recs, {{'i': record, 's': s, 'e': e, 'u': u, 'c': c, 't': item}}) ELSE recs END,
CASE WHEN x = 'created' THEN list_append(items, {{'i': item, 'k': k, 'a': true}}) ELSE items END,
CASE WHEN x IN ('created', 'updated', 'unchanged') THEN list_concat(list_filter(names, lambda y: y.i <> item), [{{'n': 'url', 'v': u, 'i': item}}, {{'n': 'title', 'v': t, 'i': item}}]) ELSE names END,
record, item, reason, x
FROM (SELECT *, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN rec.i IS NOT NULL THEN CASE WHEN rec.c = c THEN 'unchanged' ELSE 'updated' END WHEN nu IS NOT NULL THEN 'linked' ELSE 'created' END AS x,
CASE WHEN rec.i IS NOT NULL THEN rec.i WHEN reason IS NULL THEN concat('new:', CAST(id AS VARCHAR)) END AS record, CASE WHEN rec.i IS NOT NULL THEN rec.t WHEN reason IS NULL THEN coalesce(nu, concat('new:', CAST(id AS VARCHAR))) END AS item
FROM (SELECT *, CASE WHEN two THEN 'two_records' WHEN rec.i IS NOT NULL AND NOT coalesce(own_ok, false) THEN 'inactive_item' WHEN own IS NOT NULL AND several THEN 'identity_conflict' WHEN NOT coalesce(nu_ok, true) OR NOT coalesce(nt_ok, true) OR nu <> nt OR own <> nu OR own <> nt THEN 'identity_conflict' WHEN rec.i IS NULL AND nu IS NULL AND nt IS NOT NULL THEN 'title_only' END AS reason
FROM (SELECT *, CASE WHEN nu IS NOT NULL THEN len(list_filter(items, lambda y: y.i = nu AND y.k = k AND y.a)) > 0 END AS nu_ok, CASE WHEN nt IS NOT NULL THEN len(list_filter(items, lambda y: y.i = nt AND y.k = k AND y.a)) > 0 END AS nt_ok, CASE WHEN own IS NOT NULL THEN len(list_filter(items, lambda y: y.i = own AND y.k = k AND y.a)) > 0 END AS own_ok,
len(list_filter(names, lambda y: y.i = own AND y.n = 'url')) > 1 OR len(list_filter(names, lambda y: y.i = own AND y.n = 'title')) > 1 AS several
FROM (SELECT *, ra.i <> rb.i AS two, CASE WHEN ra.i IS NOT NULL THEN ra ELSE rb END AS rec, CASE WHEN ra.i IS NOT NULL THEN ra.t WHEN rb.i IS NOT NULL THEN rb.t ELSE nu END AS own
FROM (SELECT r.*, f.recs, f.items, f.names, list_filter(f.recs, lambda y: y.s = r.s AND y.e = r.e)[1] AS ra, list_filter(f.recs, lambda y: y.s = r.s AND y.u = r.u)[1] AS rb, list_filter(f.names, lambda y: y.n = 'url' AND y.v = r.u)[1].i AS nu, list_filter(f.names, lambda y: y.n = 'title' AND y.v = r.t)[1].i AS nt FROM f JOIN r ON r.b = f.b AND r.n = f.n + 1))))))
SELECT id, {{columns}} FROM f WHERE n > 0"""


def _joint(t):
    name = lambda p, x=F.col("id"): F.concat(F.lit(p), x.cast("string"))
    i = F.col("id")
    records = t.indicators.where("id % 4 = 0").select(name("r").alias("id"), name("s", i % 2).alias("source"), name("e").alias("external_id"), name("u").alias("url_hash"), F.col("kind").alias("content_hash"), F.when(i % 23 > 0, name("i", i - i % 100 % 3)).alias("item"))
    items = t.indicators.select(name("i").alias("id"), F.when(i % 8 == 0, "news").otherwise("advisory").alias("item_type"), "status")
    even = i % 2 == 0
    names = t.indicators.where("id % 5 < 2").select(F.when(even, "url").otherwise("title").alias("namespace"), F.when(even, name("u")).otherwise(name("t")).alias("value"), name("i", i - i % 100 % 3).alias("item"))
    return I.resolved_publications(_feed(t), records, items, names).withColumnRenamed("place", "id")


@query(_JOINT.replace("{columns}", "record, outcome"))
def u01_joint_identity(t):
    return _joint(t).select("id", "record", "outcome")


@query(_JOINT.replace("{columns}", "item, outcome, reason"))
def u02_identity_resolution(t):
    return _joint(t).select("id", "item", "outcome", "reason")


_M = """WITH c AS (SELECT id, kind AS v, TIMESTAMP '2024-01-01' AS seen FROM indicators WHERE status = 'active'), i AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'NEW' ELSE kind END AS v, TIMESTAMP '2024-02-01' AS seen FROM indicators WHERE NOT revoked)
SELECT coalesce(c.id, i.id) AS id, CASE WHEN i.id IS NULL OR (c.id IS NOT NULL AND c.v = i.v) THEN c.v ELSE i.v END AS v, coalesce(i.seen, c.seen) AS seen, CASE WHEN i.id IS NULL THEN 'absent' WHEN c.id IS NULL THEN 'created' WHEN c.v = i.v THEN 'unchanged' ELSE 'updated' END AS outcome FROM c FULL JOIN i ON c.id = i.id"""


def _incoming(t):
    return t.indicators.where("not revoked").select("id", F.when(F.col("id") % 5 == 0, "NEW").otherwise(F.col("kind")).alias("v"), F.expr("timestamp_ntz'2024-02-01 00:00:00'").alias("seen"))


@query(_M)
def u03_vulnerability_upsert(t):
    c = t.indicators.where("status = 'active'").select("id", F.col("kind").alias("v"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("seen"))
    return U.merged(c, _incoming(t), ["id"], ["v"], "seen")


@query(f"SELECT id, v, seen FROM ({_M})")
def k04_upsert_sink(t):
    root = shared_folder(t, "state")
    sinks.write_state(t.indicators.where("status = 'active'").select("id", F.col("kind").alias("v"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("seen")), root, 1)
    new = U.merged(sinks.read_state(t.spark, root), _incoming(t), ["id"], ["v"], "seen").drop("outcome")
    try:
        # a job that is lost on its last rows: nothing of it is seen, and it can be tried again
        sinks.write_state(new.withColumn("v", F.when(F.col("id") % 97 == 0, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v"))), root, 2)
    except PySparkException:
        sinks.write_state(new, root, 2)
    try:
        sinks.write_state(new.limit(0), root, 2)  # another writer, too late
    except sinks.VersionTaken:
        return sinks.read_state(t.spark, root)
    raise RuntimeError("a version was committed twice")


@query("""WITH s AS (SELECT item_id AS id, max(seen) AS d, count(*) AS score FROM records GROUP BY 1), i AS (SELECT id, item_type, CASE WHEN id % 3 = 0 THEN NULL ELSE published END AS d, 1 AS score FROM items WHERE status = 'active')
SELECT s.id, CASE WHEN s.d > TIMESTAMP '2001-01-01' THEN 'rejected' WHEN i.id IS NULL OR i.item_type <> 'vulnerability' THEN 'skipped' WHEN i.d > s.d THEN 'stale' WHEN i.score = s.score AND i.d = s.d THEN 'unchanged' ELSE 'updated' END AS outcome FROM s LEFT JOIN i ON s.id = i.id""")
def u04_score_enrichment(t):
    s = t.records.groupBy(F.col("item_id").alias("id")).agg(F.max("seen").alias("score_date"), F.count(F.lit(1)).alias("score"))
    i = t.items.where("status = 'active'").select("id", "item_type", F.when(F.col("id") % 3 != 0, F.col("published")).alias("score_date"), F.lit(1).cast("long").alias("score"))
    return U.enriched_scores(i, s, F.expr("timestamp_ntz'2001-01-01 00:00:00'")).select("id", "outcome")


@query("SELECT i.id, CASE WHEN r.item_id IS NULL THEN 'absent' WHEN i.kev_status = 'listed' AND i.published IS NOT DISTINCT FROM r.d THEN 'unchanged' ELSE 'updated' END AS outcome FROM items i LEFT JOIN (SELECT item_id, min(published) AS d FROM records WHERE flag = 'R' GROUP BY 1) r ON i.id = r.item_id")
def u05_catalog_enrichment(t):
    cur = t.items.select("id", (F.col("kev_status") == "listed").alias("listed"), F.col("published").alias("added"), F.lit(0).alias("seen"))
    inc = t.records.where("flag = 'R'").groupBy(F.col("item_id").alias("id")).agg(F.min("published").alias("added")).select("id", F.lit(True).alias("listed"), "added", F.lit(1).alias("seen"))
    return U.merged(cur, inc.join(cur.select("id"), "id", "left_semi"), ["id"], ["listed", "added"], "seen").select("id", "outcome")


@query("WITH one AS (SELECT item_id, min(value) AS v, count(DISTINCT value) AS c FROM identifiers WHERE namespace = 'cve' GROUP BY 1) SELECT item_id, CASE WHEN c > 1 THEN 'skipped' WHEN v IN (SELECT concat('CVE-2099-', CAST(10000 + id AS VARCHAR)) FROM indicators WHERE status = 'revoked') THEN 'listed' ELSE 'not_listed' END AS outcome FROM one")
def u06_listing_reconcile(t):
    c = t.indicators.where("status = 'revoked'").select(F.concat(F.lit("CVE-2099-"), (10000 + F.col("id")).cast("string")).alias("value"))
    return U.reconciled_listing(t.identifiers.where("namespace = 'cve'"), c)


@query("SELECT indicator_id, source_id, min(seen) AS first_seen, max(seen) AS last_seen, CAST(max(confidence) AS DOUBLE) AS confidence, arg_max(url, (confidence, url)) AS context FROM records GROUP BY 1, 2")
def u07_evidence_merge(t):
    e = t.records.select("indicator_id", "source_id", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), "confidence", F.col("url").alias("context"), "flag")
    m = U.widened(e.where("flag = 'R'").drop("flag"), e.where("flag <> 'R'").drop("flag"), ["indicator_id", "source_id"])
    return m.withColumn("confidence", F.col("confidence").cast("double"))


@query("SELECT id, CASE WHEN status <> 'active' THEN 'not_active' WHEN item_type NOT IN ('advisory','report') THEN 'wrong_type' ELSE 'eligible' END AS eligibility, coalesce(published, collected) AS observed FROM items")
def u08_extraction_eligibility(t):
    return t.items.select("id", F.when(F.col("status") != "active", "not_active").when(~F.col("item_type").isin("advisory", "report"), "wrong_type").otherwise("eligible").alias("eligibility"), F.coalesce("published", "collected").alias("observed"))


@query("""WITH s AS (SELECT owner AS id, max(created) AS m, arg_max(id, (created, id)) AS p, arg_max(id % 5 = 0, (created, id)) AS r FROM items WHERE status = 'archived' GROUP BY 1), n AS (SELECT owner AS id, created AS modified, id AS payload FROM items WHERE status = 'active' OR kev_status = 'listed')
SELECT n.id, n.modified, CASE WHEN s.id IS NULL THEN 'created' WHEN modified < m THEN 'stale' WHEN modified = m AND payload = p THEN 'unchanged' WHEN modified = m OR r THEN 'conflict' ELSE 'updated' END AS outcome FROM n LEFT JOIN s ON n.id = s.id""")
def u09_versioned_import(t):
    one = t.items.where("status = 'archived'").groupBy(F.col("owner").alias("k")).agg(F.max_by(F.struct("created", "id"), F.struct("created", "id")).alias("x"))
    s = one.select(F.col("k").alias("id"), F.col("x.created").alias("modified"), F.col("x.id").alias("payload"), (F.col("x.id") % 5 == 0).alias("revoked"))
    n = t.items.where("status = 'active' or kev_status = 'listed'").select(F.col("owner").alias("id"), F.col("created").alias("modified"), F.col("id").alias("payload"))
    return U.version_outcomes(s, n)


_TYPES = "CASE id % 4 WHEN 0 THEN 'intrusion-set' WHEN 1 THEN 'malware' WHEN 2 THEN 'attack-pattern' ELSE 'campaign' END"


@query(f"""WITH n AS (SELECT id, {_TYPES} AS type FROM indicators WHERE status = 'active'), e AS (SELECT indicator_id AS source, source_id AS target, CASE WHEN flag = 'R' THEN 'attributed-to' ELSE 'uses' END AS kind FROM records)
SELECT e.source, e.kind, e.target, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'missing_end' WHEN source = target THEN 'self_edge' WHEN (a.type, kind, b.type) IN (('intrusion-set','uses','malware'),('intrusion-set','uses','attack-pattern'),('campaign','uses','malware'),('campaign','uses','attack-pattern'),('malware','uses','attack-pattern'),('campaign','attributed-to','intrusion-set')) THEN 'accepted' ELSE 'not_approved' END AS outcome
FROM e LEFT JOIN n a ON e.source = a.id LEFT JOIN n b ON e.target = b.id""")
def u10_checked_edges(t):
    n = t.indicators.where("status = 'active'").select("id", F.expr(_TYPES).alias("type"))
    e = t.records.select(F.col("indicator_id").alias("source"), F.when(F.col("flag") == "R", "attributed-to").otherwise("uses").alias("kind"), F.col("source_id").alias("target"))
    return U.checked_edges(e, n)


@query("SELECT item_id AS id, indicator_id AS ref FROM records WHERE indicator_id NOT IN (SELECT id FROM indicators WHERE status = 'active') AND indicator_id NOT IN (SELECT id FROM people WHERE segment = 'BUILDING')")
def u11_dangling(t):
    refs = t.records.select(F.col("item_id").alias("id"), F.col("indicator_id").alias("ref"))
    return U.dangling(refs, t.indicators.where("status = 'active'"), t.people.where("segment = 'BUILDING'")).select("id", "ref")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'protected' ELSE 'would_update' END AS outcome FROM items")
def u12_classifier_apply(t):
    from ..functions.relevance import applied

    return t.items.select("id", applied(F.when(F.col("id") % 4 == 0, "manual").otherwise("automatic"), True).alias("outcome"))


_CAS = """WITH s AS (SELECT id, id % 5 + 1 AS version, kind AS v FROM indicators WHERE status = 'active'), u AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE 2 END AS expected_version, CASE WHEN id % 2 = 0 THEN kind ELSE 'NEW' END AS v FROM indicators),
j AS (SELECT u.id, s.version AS old, s.v AS ov, u.v AS nv, CASE WHEN s.id IS NULL AND expected_version IS NULL THEN 'created' WHEN s.id IS NULL OR expected_version IS NULL OR s.version <> expected_version THEN 'conflict' WHEN s.v = u.v THEN 'unchanged' ELSE 'updated' END AS outcome FROM u LEFT JOIN s ON u.id = s.id)
SELECT id, CASE outcome WHEN 'created' THEN 1 WHEN 'updated' THEN old + 1 ELSE old END AS version, CASE WHEN outcome IN ('created','updated') THEN nv ELSE ov END AS v, outcome FROM j"""


def _cas(t):
    s = t.indicators.where("status = 'active'").select("id", (F.col("id") % 5 + 1).alias("version"), F.col("kind").alias("v"))
    u = t.indicators.select("id", F.when(F.col("id") % 7 != 0, 2).alias("expected_version"), F.when(F.col("id") % 2 == 0, F.col("kind")).otherwise("NEW").alias("v"))
    return U.compared_and_set(s, u, ["id"], "v").withColumn("version", F.col("version").cast("long"))


_ADVANCE = """WITH s AS (SELECT id, id % 5 + 1 AS version, id % 50 AS v FROM indicators WHERE status = 'active'), p AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'running' ELSE 'checkpoint_pending' END AS status, CASE WHEN id % 3 = 0 THEN 'no_change' ELSE 'success' END AS result, CASE WHEN id % 13 = 0 THEN 9 ELSE coalesce((SELECT version FROM s WHERE s.id = i.id), 0) END AS expected, CASE WHEN id % 2 = 0 THEN id % 50 WHEN id % 7 = 0 THEN id % 50 - 1 ELSE id % 50 + 1 END AS v FROM indicators i),
j AS (SELECT p.id, s.version AS old, s.v AS ov, p.v AS nv, CASE WHEN status <> 'checkpoint_pending' THEN 'not_pending' WHEN expected <> coalesce(s.version, 0) THEN 'stale' WHEN s.v = p.v AND result = 'no_change' THEN 'unchanged' WHEN s.v = p.v {back} THEN 'conflict' ELSE 'advanced' END AS outcome FROM p LEFT JOIN s ON p.id = s.id)
SELECT id, CASE WHEN outcome = 'advanced' THEN coalesce(old, 0) + 1 ELSE old END AS version, CASE WHEN outcome = 'advanced' THEN nv ELSE ov END AS v, outcome FROM j"""


def _advance(t, monotone):
    i = F.col("id")
    s = t.indicators.where("status = 'active'").select("id", (i % 5 + 1).alias("version"), (i % 50).alias("v"))
    p = t.indicators.join(s.select("id", "version"), "id", "left").select(
        "id",
        F.when(i % 11 == 0, "running").otherwise("checkpoint_pending").alias("status"),
        F.when(i % 3 == 0, "no_change").otherwise("success").alias("result"),
        F.when(i % 13 == 0, 9).otherwise(F.coalesce("version", F.lit(0))).alias("expected_version"),
        F.when(i % 2 == 0, i % 50).when(i % 7 == 0, i % 50 - 1).otherwise(i % 50 + 1).alias("v"),
    )
    return U.advanced(s, p, ["id"], "v", monotone).withColumn("version", F.col("version").cast("long"))


@query(_ADVANCE.format(back=""))
def u13_checkpoints(t):
    return _advance(t, False)


@query(_ADVANCE.format(back="OR p.v < s.v"))
def u13_watermarks(t):
    return _advance(t, True)


@query(_CAS)
def u17_rate_limit_cas(t):
    return _cas(t)


_STATUS = "CASE WHEN sequence = (SELECT min(sequence) FROM turns) THEN 'running' ELSE CASE length(text) % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'no_change' WHEN 3 THEN 'running' ELSE 'checkpoint_pending' END END"


@query(f"""WITH RECURSIVE r AS (SELECT run, sequence, row_number() OVER (PARTITION BY run ORDER BY sequence) AS n, {_STATUS} AS x FROM turns),
f AS (SELECT run, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sequence, false AS legal, CAST(NULL AS VARCHAR) AS state FROM (SELECT DISTINCT run FROM r)
UNION ALL SELECT run, n, sequence, ok, CASE WHEN ok THEN x ELSE state END FROM (SELECT r.*, f.state, CASE WHEN f.state IS NULL THEN x = 'running' WHEN f.state = 'running' THEN x IN ('checkpoint_pending','success','no_change','partial','failed','cancelled') WHEN f.state = 'checkpoint_pending' THEN x IN ('success','no_change','failed','cancelled') ELSE false END AS ok FROM f JOIN r ON r.run = f.run AND r.n = f.n + 1))
SELECT CAST(run AS VARCHAR) AS run, sequence, legal, state FROM f WHERE n > 0""")
def u14_run_states(t):
    length = F.length("text") % 7
    first = t.turns.agg(F.min("sequence")).first()[0]
    x = F.when(F.col("sequence") == first, "running").when(length == 0, "success").when(length == 1, "failed").when(length == 2, "no_change").when(length == 3, "running").otherwise("checkpoint_pending")
    return B.run_states(t.turns.withColumn("status", x), "run", "sequence", "status")


@query("SELECT run, arg_max(state, sequence) AS state, count(*) AS events FROM turns GROUP BY run")
def u14_folded_state(t):
    return U.folded(t.turns, "run", "state", "sequence")


_CYCLE = "concat('k', CAST({k} AS VARCHAR)) AS key, CASE WHEN {k} % 2 = 0 THEN 'scheduled' ELSE 'manual' END AS trigger, {n} AS expected"


@query(f"""WITH e AS (SELECT {_CYCLE.format(k="id * 2", n="id % 3")}, CASE WHEN id % 4 = 1 THEN 'failed' ELSE 'success' END AS status FROM people UNION ALL SELECT {_CYCLE.format(k="id * 4 + 1", n="id % 3")}, 'running' FROM people), i AS (SELECT id, {_CYCLE.format(k="id // 3", n="CASE WHEN id % 7 = 0 THEN 9 ELSE id // 3 // 2 % 3 END")} FROM runs),
f AS (SELECT key, min(id) AS born, arg_min(expected, id) AS n FROM i GROUP BY key), w AS (SELECT min(born) AS born FROM f JOIN (SELECT DISTINCT key, trigger FROM i) g USING (key) WHERE trigger = 'scheduled' AND key NOT IN (SELECT key FROM e))
SELECT i.id, CASE WHEN e.key IS NULL AND i.trigger = 'scheduled' AND (f.born <> w.born OR (SELECT count(*) FROM e WHERE trigger = 'scheduled' AND status = 'running') > 0) THEN 'overlap' WHEN e.key IS NULL AND i.id = f.born THEN 'acquired' WHEN coalesce(e.expected, f.n) = i.expected THEN 'reused' ELSE 'conflict' END AS outcome
FROM i JOIN f USING (key) CROSS JOIN w LEFT JOIN e ON e.key = i.key""")
def u15_cycle_acquire(t):
    # all people stand for stored cycles, two each: finished scheduled ones, and manual ones that run
    cycle = lambda k: [F.concat(F.lit("k"), k.cast("string")).alias("key"), F.when(k % 2 == 0, "scheduled").otherwise("manual").alias("trigger")]
    done = t.people.select(*cycle(F.col("id") * 2), (F.col("id") % 3).alias("expected"), F.when(F.col("id") % 4 == 1, "failed").otherwise("success").alias("status"))
    e = done.unionByName(t.people.select(*cycle(F.col("id") * 4 + 1), (F.col("id") % 3).alias("expected"), F.lit("running").alias("status")))
    k = F.expr("id div 3")
    i = t.runs.select("id", *cycle(k), F.when(F.col("id") % 7 == 0, 9).otherwise(F.expr("id div 3 div 2 % 3")).alias("expected"))
    return U.acquired_cycles(e, i, "key", ["trigger", "expected"], "id").select("id", "outcome")


@query("WITH e AS (SELECT id AS key, kind FROM indicators WHERE status = 'active'), i AS (SELECT item_id AS born, indicator_id AS key, CASE WHEN flag = 'R' THEN 'OTHER' ELSE k.kind END AS kind FROM records JOIN indicators k ON k.id = indicator_id WHERE is_primary), f AS (SELECT key, min(born) AS born, arg_min(kind, born) AS kind FROM (SELECT DISTINCT * FROM i) GROUP BY key) SELECT i.born, i.key, CASE WHEN e.key IS NULL AND i.born = f.born THEN 'inserted' WHEN coalesce(e.kind, f.kind) = i.kind THEN 'reused' ELSE 'conflict' END AS outcome FROM i JOIN f ON f.key = i.key LEFT JOIN e ON e.key = i.key")
def u21_seed_writer(t):
    e = t.indicators.where("status = 'active'").select(F.col("id").alias("key"), "kind")
    kinds = t.indicators.select(F.col("id").alias("key"), "kind")
    r = t.records.where("is_primary").select(F.col("item_id").alias("born"), F.col("indicator_id").alias("key"), "flag").join(kinds, "key")
    i = r.select("born", "key", F.when(F.col("flag") == "R", "OTHER").otherwise(F.col("kind")).alias("kind"))
    return U.inserted(e, i, "key", ["kind"], "born").select("born", "key", "outcome")


@query("SELECT id, attempt FROM runs WHERE status IN ('failed','partial') AND attempt < 3 AND id IN (SELECT run_id FROM errors WHERE retryable)")
def u16_retryable(t):
    return U.retryable(t.runs, t.errors, 3).select("id", "attempt")


@query("SELECT id, array_to_string(list_sort(list_filter(['no_deletion_policy', CASE WHEN status = 'active' THEN 'active_item' END, CASE WHEN relevance = 'confirmed' THEN 'confirmed_relevance' END, CASE WHEN id IN (SELECT item_id FROM records) THEN 'has_records' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM items")
def u18_protected_plan(t):
    from ..operators.joins import flagged

    df = flagged(t.items, "id", has_records=(t.records, "item_id"))
    plan = U.protected_plan(df, "id", {"active_item": F.col("status") == "active", "confirmed_relevance": F.col("relevance") == "confirmed", "has_records": F.col("has_records")})
    return plan.select("id", F.array_join("reasons", ",").alias("reasons"))


@query("WITH k AS (SELECT DISTINCT sha256(concat_ws('|', CAST(source AS VARCHAR), status)) AS key FROM runs WHERE attempt >= 2) SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT sha256(concat_ws('|', CAST(source AS VARCHAR), status)) FROM runs WHERE attempt < 2)")
def u19_audit_append(t):
    from ..functions.text import digest_key
    from ..operators.joins import lacking

    keyed = t.runs.select("attempt", digest_key("source", "status").alias("key"))
    return lacking(keyed.where("attempt >= 2").select("key").distinct(), "key", keyed.where("attempt < 2"), "key")


@query("SELECT p.id, CASE WHEN r.id IS NOT NULL THEN 'conflict' ELSE 'acquired' END AS outcome FROM people p LEFT JOIN (SELECT DISTINCT source AS id FROM runs WHERE status = 'running') r ON p.id = r.id")
def u20_run_acquire(t):
    from ..operators.joins import flagged

    return flagged(t.people, "id", busy=(t.runs.where("status = 'running'"), "source")).select("id", F.when(F.col("busy"), "conflict").otherwise("acquired").alias("outcome"))
