"""Filtered, ordered, paged lists and read models."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import filters as C
from ..operators import paging as L
from ..operators import projections as P
from ..operators import ranking as W
from ..operators.joins import primary_record
from ..sources.sinks import metric_lines, record_lines, report_rows
from .analogues import query


@query("SELECT id, title, published FROM items WHERE status = 'active' AND item_type = 'vulnerability' AND published >= TIMESTAMP '1997-01-01' AND published < TIMESTAMP '1998-01-01' ORDER BY published DESC NULLS LAST, id DESC LIMIT 25 OFFSET 5")
def items_newest_page(t):
    df = C.of_type(C.active(t.items), "").where(C.in_year("published", 1997))
    return L.page(df.select("id", "title", "published"), L.orders("newest_published"), 25, 5)


@query("SELECT id, status FROM items WHERE status = 'active'")
def f01_active(t):
    return C.active(t.items).select("id", "status")


@query("SELECT id, item_type FROM items WHERE item_type = 'vulnerability'")
def f02_type_default(t):
    return C.of_type(t.items, " ").select("id", "item_type")


@query("SELECT id, item_type FROM items WHERE item_type <> 'vulnerability'")
def f03_article_types(t):
    return C.articles(t.items).select("id", "item_type")


@query("SELECT id, published FROM items WHERE extract(year FROM published) = 1996")
def f04_published_year(t):
    return t.items.where(C.in_year("published", 1996)).select("id", "published")


@query("SELECT id, published FROM items WHERE CAST(published AS DATE) BETWEEN DATE '1996-02-29' AND DATE '1996-03-31'")
def f05_date_range(t):
    return t.items.where(C.between_days("published", date(1996, 2, 29), date(1996, 3, 31))).select("id", "published")


@query("SELECT id, CAST(created AS DATE) + CAST(id % 8 * 366 - 200 AS INTEGER) <= CAST(CAST(created AS DATE) + INTERVAL 5 YEAR AS DATE) AND id % 8 > 0 AS allowed FROM items")
def f06_span_limit(t):
    day = F.to_date("created")
    return t.items.select("id", C.span_allowed(day, F.date_add(day, (F.col("id") % 8 * 366 - 200).cast("int"))).alias("allowed"))


@query("SELECT * FROM (VALUES ('2024-02-29','2029-02-28',true),('2024-02-29','2029-03-01',false),('2020-01-01','2025-01-01',true),('2020-01-01','2025-01-02',false),('2020-01-02','2020-01-01',false)) v(first, last, allowed)")
def f06_leap_days(t):
    rows = t.spark.createDataFrame([("2024-02-29", "2029-02-28"), ("2024-02-29", "2029-03-01"), ("2020-01-01", "2025-01-01"), ("2020-01-01", "2025-01-02"), ("2020-01-02", "2020-01-01")], "first string, last string")
    return rows.select("first", "last", C.span_allowed("first", "last").alias("allowed"))


@query("SELECT id, title FROM items WHERE position('50%_o' IN lower(title)) > 0")
def f07_literal_search(t):
    return t.items.where(C.contains_any("50%_O", "title")).select("id", "title")


@query("SELECT id, name FROM people WHERE position('007' IN name) > 0 OR EXISTS (SELECT 1 FROM items WHERE owner = people.id AND position('007' IN title) > 0)")
def f08_search_related(t):
    return C.matching_or_related(t.people, "007", ["name"], "id", t.items, "owner", "title").select("id", "name")


@query("SELECT id, entity FROM indicators WHERE position('77' IN CAST(id AS VARCHAR)) > 0 OR position('77' IN value) > 0 OR EXISTS (SELECT 1 FROM records WHERE indicator_id = indicators.id AND position('77' IN coalesce(external_id, '')) > 0)")
def f09_search_aliases(t):
    return C.matching_or_related(t.indicators, "77", ["value", F.col("id").cast("string")], "id", t.records, "indicator_id", "external_id").select("id", "entity")


@query("SELECT id, revoked FROM indicators WHERE revoked")
def f10_revoked(t):
    return C.three_state(t.indicators, "revoked", True).select("id", "revoked")


@query("SELECT id, 'direct' AS kind FROM items WHERE relevance = 'confirmed' UNION ALL SELECT id, 'potential' FROM items WHERE relevance IN ('probable','possible') UNION ALL SELECT id, 'global' FROM items WHERE relevance = 'not_relevant' AND scope = 'global' UNION ALL SELECT id, 'no_evidence' FROM items WHERE relevance = 'unknown'")
def f11_relevance_buckets(t):
    kinds = ["direct", "potential", "global", "no_evidence"]
    found = F.array_compact(F.array(*(F.when(C.relevance(k), k) for k in kinds)))
    return t.items.select("id", F.explode(found).alias("kind"))


@query("SELECT id, kind, status FROM indicators WHERE status = 'active' AND kind = 'PROMO'")
def f12_indicator_filters(t):
    return t.indicators.where("status = 'active' and kind = 'PROMO'").select("id", "kind", "status")


@query("SELECT id, slug FROM sources WHERE (slug LIKE 'Supplier#00000001%' OR slug LIKE 'Supplier#00000002%') AND balance IS NOT NULL")
def f13_prefixes(t):
    return t.sources.where(C.starts_with_any("slug", ["Supplier#00000001", "Supplier#00000002"]) & F.col("balance").isNotNull()).select("id", "slug")


@query("SELECT id, source, status FROM runs WHERE started >= TIMESTAMP '2024-01-05' AND started < TIMESTAMP '2024-01-12' AND status = 'failed'")
def f14_history(t):
    return C.history(t.runs, "started", datetime(2024, 1, 5), datetime(2024, 1, 12), 90, status="failed").select("id", "source", "status")


@query("SELECT id, value FROM runs WHERE started >= TIMESTAMP '2024-01-01' AND started < TIMESTAMP '2024-01-03' AND source = 8")
def f15_audit(t):
    return C.history(t.runs, "started", datetime(2024, 1, 1), datetime(2024, 1, 3), 366, source=8).select("id", "value")


@query(r"""WITH x AS (SELECT id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+$', '')) AS line FROM publications)
SELECT id, CASE WHEN line = '' THEN 'none' WHEN length(line) > 120 OR regexp_matches(line, '[<>\x00-\x1F\x7F-\x9F]') THEN 'rejected' ELSE 'given' END AS state, CASE WHEN line <> '' AND length(line) <= 120 AND NOT regexp_matches(line, '[<>\x00-\x1F\x7F-\x9F]') THEN line END AS search FROM x""")
def f16_search_parameters(t):
    p = t.publications.select("id", F.substring_index("text", "\n", 1).alias("line"))
    return p.select("id", C.search_state("line").alias("state"), C.search_text("line").alias("search"))


@query("SELECT id, CASE WHEN regexp_matches(lower(name), '^[a-z0-9]+(-[a-z0-9]+)*$') THEN lower(name) END AS slug, CASE WHEN lower(segment) IN ('building', 'household') THEN lower(segment) END AS choice FROM (SELECT id, CASE WHEN id % 3 = 0 THEN replace(name, '#', '-') ELSE name END AS name, segment FROM people)")
def f16_parameters(t):
    name = F.when(F.col("id") % 3 == 0, F.replace("name", F.lit("#"), F.lit("-"))).otherwise(F.col("name"))
    return t.people.select("id", C.slug_parameter(name).alias("slug"), C.choice("segment", ("building", "household")).alias("choice"))


@query("SELECT id, item_type = 'vulnerability' OR severity IS NULL AND kev IS NULL AS allowed FROM (SELECT id, item_type, severity, CASE WHEN kev_status = 'listed' THEN kev_status END AS kev FROM items)")
def f17_combinations(t):
    return t.items.select("id", C.combination_allowed("item_type", "severity", F.when(F.col("kev_status") == "listed", F.col("kev_status"))).alias("allowed"))


_STATES = "id % 7 <> 0 AS implemented, id % 5 <> 0 AS enabled, CASE id % 6 WHEN 0 THEN 'disabled' WHEN 1 THEN 'paused' ELSE 'enabled' END AS operator_state, id % 4 = 0 AS needs_credentials, id % 8 = 0 AS has_credentials, CASE id % 9 WHEN 0 THEN 'quota_unavailable' WHEN 1 THEN 'limited' WHEN 2 THEN 'backoff' ELSE 'available' END AS rate_state"
_LADDER = """CASE WHEN NOT implemented THEN 'not_implemented' WHEN NOT enabled THEN 'policy_disabled' WHEN operator_state = 'disabled' THEN 'disabled' WHEN operator_state = 'paused' THEN 'paused'
WHEN needs_credentials AND NOT has_credentials THEN 'credentials_required' WHEN rate_state = 'quota_unavailable' THEN 'quota_unavailable'
WHEN rate_state IN ('limited','backoff') AND (backoff_until IS NULL OR backoff_until > TIMESTAMP '2024-01-15') THEN 'rate_limited' WHEN running THEN 'active' ELSE 'eligible' END"""
_NOW = "timestamp_ntz'2024-01-15 00:00:00'"


def _states(t):
    more = ["CASE WHEN id % 10 = 0 THEN NULL ELSE timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 30 as int)) END AS backoff_until", "id % 3 = 0 AS running"]
    return t.sources.selectExpr("id", "slug", *_STATES.split(", "), *more)


def _oracle_states(rest: str) -> str:
    return f"WITH st AS (SELECT id, slug, {_STATES}, CASE WHEN id % 10 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL (id % 30) DAY END AS backoff_until, id % 3 = 0 AS running FROM sources) {rest}"


@query(_oracle_states(f"SELECT id, {_LADDER} AS effective_state FROM st"))
def f18_effective_state(t):
    return _states(t).select("id", C.effective_state(F.expr(_NOW)).alias("effective_state"))


@query(
    _oracle_states("""SELECT id, CASE WHEN NOT implemented THEN 'not_implemented' WHEN NOT enabled THEN 'policy_disabled' WHEN needs_credentials AND NOT has_credentials THEN 'credentials_required' ELSE 'implemented_enabled' END AS policy,
 CASE WHEN NOT (enabled AND implemented) THEN 'not_applicable' WHEN backoff_until IS NULL THEN 'never' WHEN TIMESTAMP '2024-01-15' - backoff_until <= INTERVAL 4 HOUR THEN 'fresh' ELSE 'stale' END AS freshness,
 concat_ws(',', CASE WHEN NOT running AND operator_state = 'enabled' THEN 'pause' END, CASE WHEN NOT running AND operator_state = 'paused' THEN 'resume' END, CASE WHEN NOT running AND operator_state IN ('enabled','paused') THEN 'disable' END,
 CASE WHEN NOT running AND operator_state = 'disabled' AND enabled AND implemented THEN 'enable' END, CASE WHEN NOT running AND operator_state = 'enabled' AND enabled AND implemented THEN 'manual_run' END) AS actions FROM st""")
)
def f19_policy_freshness_actions(t):
    usable = F.col("enabled") & F.col("implemented")
    return _states(t).select(
        "id",
        C.policy_state("implemented", "enabled", "needs_credentials", "has_credentials").alias("policy"),
        C.freshness(F.expr(_NOW), "backoff_until", usable).alias("freshness"),
        F.array_join(C.available_actions("operator_state", "running", usable, F.lit(True)), ",").alias("actions"),
    )


@query(_oracle_states(f"SELECT id, effective_state FROM (SELECT id, {_LADDER} AS effective_state FROM st) WHERE effective_state = 'eligible' ORDER BY id LIMIT 5 OFFSET 2"))
def f20_derived_page(t):
    return C.derived_page(_states(t), C.effective_state(F.expr(_NOW)), "eligible", ["id"], 2, 5).select("id", "effective_state")


@query("SELECT id, title FROM items WHERE id = 77")
def f21_by_public_id(t):
    return C.by_public_id(t.items, "id", 77).select("id", "title")


@query("SELECT id, title, created FROM items ORDER BY created DESC, id DESC LIMIT 50")
def l01_recently_ingested(t):
    return L.page(t.items.select("id", "title", "created"), L.orders("recently_ingested"), 50)


@query("SELECT id, published FROM items ORDER BY published DESC NULLS LAST, id DESC LIMIT 60 OFFSET 40")
def l02_newest_published(t):
    return L.page(t.items.select("id", "published"), L.orders("newest_published"), 60, 40)


@query("SELECT id, published FROM items ORDER BY published ASC NULLS LAST, id ASC LIMIT 60 OFFSET 140")
def l03_oldest_published(t):
    return L.page(t.items.select("id", "published"), L.orders("oldest_published"), 60, 140)


@query("SELECT id FROM items ORDER BY id LIMIT 100 OFFSET 10000")
def l04_far_page(t):
    return L.page(t.items.select("id"), [F.asc("id")], 100, 10_000)


@query("SELECT id, published, collected FROM items WHERE relevance <> 'unknown' ORDER BY published DESC NULLS LAST, collected DESC, id DESC LIMIT 100")
def l05_scope_list(t):
    return L.page(t.items.where("relevance <> 'unknown'").select("id", "published", "collected"), [F.desc_nulls_last("published"), F.desc("collected"), F.desc("id")], 100)


@query("SELECT i.id, i.value, l.last_seen FROM indicators i LEFT JOIN (SELECT indicator_id, max(published) AS last_seen FROM records GROUP BY 1) l ON i.id = l.indicator_id ORDER BY last_seen DESC NULLS LAST, id DESC LIMIT 100")
def l06_indicator_list(t):
    last = t.records.groupBy(F.col("indicator_id").alias("id")).agg(F.max("published").alias("last_seen"))
    return L.page(t.indicators.join(last, "id", "left").select("id", "value", "last_seen"), [F.desc_nulls_last("last_seen"), F.desc("id")], 100)


@query("SELECT id, title, published FROM items WHERE status = 'active' AND item_type <> 'vulnerability' ORDER BY published DESC NULLS LAST, id DESC LIMIT 5")
def l07_latest_articles(t):
    return L.page(C.articles(C.active(t.items)).select("id", "title", "published"), L.orders("newest_published"), 5)


@query("SELECT run, sequence, state FROM turns WHERE run = 3 ORDER BY sequence LIMIT 500")
def l08_run_events(t):
    return t.turns.where("run = 3").select("run", "sequence", "state").orderBy("sequence").limit(500)


@query("SELECT id, published FROM items WHERE item_type = 'vulnerability' ORDER BY published ASC NULLS FIRST, id LIMIT 500")
def l09_fair_candidates(t):
    return L.fair_candidates(C.of_type(t.items, None).select("id", "published"), "published", "id")


@query("SELECT id, id <= 1400 AS wrapped FROM people ORDER BY id <= 1400, id LIMIT 150")
def l10_keyset_wrap(t):
    return L.keyset(t.people.select("id"), "id", 1400, 150)


@query("WITH b AS (SELECT id, id <= 1400 AS wrapped FROM people ORDER BY id <= 1400, id LIMIT 150) SELECT CAST(CASE WHEN bool_or(wrapped) THEN 0 ELSE max(id) END AS BIGINT) AS cursor FROM b")
def l10_next_cursor(t):
    return L.next_cursor(L.keyset(t.people.select("id"), "id", 1400, 150), "id").select(F.col("cursor").cast("long").alias("cursor"))


@query("SELECT id, CASE WHEN relevance = 'unknown' THEN 0 WHEN scope = 'unknown' THEN 1 ELSE 2 END AS tier FROM items ORDER BY 2, id LIMIT 220")
def l11_two_tier(t):
    tier = F.when(F.col("relevance") == "unknown", 0).when(F.col("scope") == "unknown", 1).otherwise(2)
    return L.tiered(t.items, tier, [F.asc("id")], 220).select("id", "tier")


_PLAN = "SELECT * FROM (SELECT 'errors' AS category, CAST(run_id AS VARCHAR) AS id FROM errors WHERE event_type = 'error' ORDER BY 2 LIMIT 41) UNION ALL SELECT * FROM (SELECT 'people', CAST(id AS VARCHAR) FROM people WHERE segment = 'BUILDING' ORDER BY 2 LIMIT 41) UNION ALL SELECT * FROM (SELECT 'runs', CAST(id AS VARCHAR) FROM runs WHERE status = 'failed' ORDER BY 2 LIMIT 41)"


@query(f"WITH u AS ({_PLAN}), top AS (SELECT * FROM u ORDER BY category, id LIMIT 41) SELECT category, id, (SELECT count(*) FROM top) > 40 AS truncated FROM top ORDER BY category, id LIMIT 40")
def l12_retention_plan(t):
    parts = {"runs": (t.runs.where("status = 'failed'"), "id"), "errors": (t.errors.where("event_type = 'error'"), "run_id"), "people": (t.people.where("segment = 'BUILDING'"), "id")}
    return L.bounded_plan(parts, 40)


@query("SELECT id, title FROM items")
def p01_pruned(t):
    return t.items.select("id", "title")


_PRIMARY = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY NOT is_primary, coalesce(source,''), coalesce(external_id,''), url, seen, record_id) AS n FROM records) WHERE n = 1)"


@query(f"WITH {_PRIMARY} SELECT i.id, item_type, CASE WHEN p.item_id IS NOT NULL THEN p.published ELSE i.published END AS published, source, CAST(i.confidence AS DOUBLE) AS confidence FROM items i LEFT JOIN p ON i.id = p.item_id")
def p02_item_read_model(t):
    return P.serialised_item(t.items, primary_record(t.records))


@query(f"WITH {_PRIMARY} SELECT i.id, item_type, coalesce(p.published, i.published) AS published, source FROM items i LEFT JOIN p ON i.id = p.item_id WHERE item_type <> 'vulnerability'")
def p03_article_read_model(t):
    return P.serialised_article(C.articles(t.items), primary_record(t.records))


@query("SELECT id, CASE WHEN relevance = 'confirmed' THEN 'Direct evidence' WHEN relevance IN ('probable','possible') THEN 'Potential relevance' WHEN relevance = 'not_relevant' AND scope = 'global' THEN 'Global relevance' ELSE 'No demonstrated relevance' END AS label FROM items")
def p04_relevance_label(t):
    return t.items.select("id", C.relevance_label().alias("label"))


@query("SELECT id, CASE WHEN kind LIKE 'S%' THEN 'sector' WHEN kind LIKE 'M%' THEN 'language' END AS kind, 'Controlled ' || CASE WHEN kind LIKE 'S%' THEN 'sector' ELSE 'language' END || ' tag.' AS evidence FROM indicators WHERE (kind LIKE 'S%' OR kind LIKE 'M%') AND status = 'active'")
def p05_tag_kinds(t):
    tags = t.indicators.select("id", F.col("kind").alias("slug"), F.when(F.col("status") == "active", 1).alias("confidence"))
    return P.evidence_tags(tags, {"S": "sector", "M": "language"}).select("id", "kind", "evidence")


@query("SELECT id, CASE WHEN finished IS NOT NULL THEN greatest(0, epoch_us(finished) - epoch_us(started)) / 1e6 END AS seconds FROM runs")
def p06_run_duration(t):
    return t.runs.select("id", P.duration_seconds("started", "finished").alias("seconds"))


@query("SELECT cycle, min(started) AS begun, max(finished) AS ended, count(*) AS runs FROM runs GROUP BY cycle")
def p07_cycles(t):
    return t.runs.groupBy("cycle").agg(F.min("started").alias("begun"), F.max("finished").alias("ended"), F.count(F.lit(1)).alias("runs"))


@query("SELECT id, sha256(concat(id, '|', status, '|', attempt, '|', strftime(started, '%Y-%m-%dT%H:%M:%S'), CASE WHEN epoch_us(started) % 1000000 = 0 THEN '' ELSE strftime(started, '.%f') END, '+00:00')) AS fingerprint FROM runs")
def p08_progress_fingerprint(t):
    return t.runs.select("id", P.progress_fingerprint("id", "status", "attempt", "started").alias("fingerprint"))


@query("SELECT CAST(id AS VARCHAR) AS id, title, coalesce(severity, '') AS severity FROM items WHERE status = 'active' ORDER BY items.id LIMIT 100")
def p09_report(t):
    return report_rows(C.active(t.items), ["id", "title", "severity"], ["id"])


@query("SELECT id, json_extract_string(props, '$.k') AS k FROM runs")
def p10_json_details(t):
    return t.runs.select("id", P.json_details("props")["k"].alias("k"))


@query("SELECT id, CASE WHEN confidence > 1 THEN NULL WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.75 THEN 'Medium' ELSE 'Low' END AS level, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS percent FROM items")
def p11_confidence(t):
    return t.items.select("id", P.confidence_level("confidence").alias("level"), P.confidence_percent("confidence").alias("percent"))


@query("SELECT CASE WHEN id % 3 = 0 THEN '''' || x ELSE x END AS cell, id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '=' || name ELSE name END AS x FROM people)")
def k01_csv_cells(t):
    from ..functions.text import neutral_cell

    x = F.when(F.col("id") % 3 == 0, F.concat(F.lit("="), "name")).otherwise(F.col("name"))
    return t.people.select("id", neutral_cell(x).alias("cell"))


@query("SELECT id, CAST(place AS INT) AS place, 0 AS part, line FROM (SELECT id, unnest([0, 1]) AS place, unnest(['id: ' || id, 'segment: ' || segment]) AS line FROM people)")
def k02_record_lines(t):
    return record_lines(t.people.select(F.col("id"), "segment"), ["id", "segment"]).select("id", "place", "part", "line")


@query("WITH m AS (SELECT status AS name, count(*) AS value FROM runs GROUP BY 1) SELECT name, CAST(place AS INT) AS place, line FROM (SELECT name, unnest([0,1,2]) AS place, unnest(['# HELP lake_' || name || ' ' || CASE name WHEN 'no_change' THEN 'No Change' ELSE upper(name[1]) || name[2:] END, '# TYPE lake_' || name || ' gauge', 'lake_' || name || ' ' || value]) AS line FROM m)")
def k03_metrics(t):
    return metric_lines(t.runs.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("value")), "lake")


@query("SELECT entity, id, value, CAST(rank AS INT) AS rank FROM (SELECT entity, id, value, row_number() OVER (PARTITION BY entity ORDER BY value, id) AS rank FROM indicators) WHERE rank <= 20")
def w01_alias_top20(t):
    return W.first_in_group(t.indicators.select("entity", "id", "value"), ["entity"], ["value", "id"], 20)


@query("SELECT item_id, record_id, CAST(rank AS INT) AS rank FROM (SELECT item_id, record_id, row_number() OVER (PARTITION BY item_id ORDER BY seen DESC, record_id) AS rank FROM records) WHERE rank <= 3")
def w02_nested_caps(t):
    return W.first_in_group(t.records.select("item_id", "record_id", "seen"), ["item_id"], [F.desc("seen"), "record_id"], 3).drop("seen")


# The six capped lists of the detail views, over tables that stand for them.
_CHILDREN = {
    "source_records": "SELECT source_id AS parent, record_id AS child, epoch_us(seen) AS place FROM records",
    "import_runs": "SELECT source AS parent, CAST(id AS VARCHAR) AS child, epoch_us(started) AS place FROM runs",
    "indicators": "SELECT item_id % 500 AS parent, CAST(indicator_id AS VARCHAR) AS child, min(indicator_id) AS place FROM records GROUP BY 1, 2",
    "tags": "SELECT id AS parent, unnest(string_split(value, ' ')) AS child, 0 AS place FROM indicators",
    "provenances": "SELECT indicator_id AS parent, record_id AS child, source_id AS place FROM records",
    "relationships": "SELECT source AS parent, CAST(target AS VARCHAR) AS child, min(target) AS place FROM edges GROUP BY 1, 2",
}


@query("SELECT kind, parent, child, CAST(rank AS INT) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, parent, child, row_number() OVER (PARTITION BY parent ORDER BY place DESC, child) AS rank, {W.DETAIL_CAPS[k]} AS most FROM ({sql})" for k, sql in _CHILDREN.items()) + ") WHERE rank <= most")
def w02_detail_lists(t):
    r = t.records
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s = lambda c: F.col(c).cast("string")
    return W.detail_lists(
        {
            "source_records": r.select(F.col("source_id").alias("parent"), F.col("record_id").alias("child"), micros("seen").alias("at")),
            "import_runs": t.runs.select(F.col("source").alias("parent"), s("id").alias("child"), micros("started").alias("at")),
            "indicators": r.select((F.col("item_id") % 500).alias("parent"), s("indicator_id").alias("child"), F.col("indicator_id").alias("at")).distinct(),
            "tags": t.indicators.select(F.col("id").alias("parent"), F.explode(F.split("value", " ")).alias("child"), F.lit(0).cast("long").alias("at")),
            "provenances": r.select(F.col("indicator_id").alias("parent"), F.col("record_id").alias("child"), F.col("source_id").alias("at")),
            "relationships": t.edges.select(F.col("source").alias("parent"), s("target").alias("child"), F.col("target").alias("at")).distinct(),
        }
    )


@query("SELECT source, id, status FROM (SELECT source, id, status, row_number() OVER (PARTITION BY source ORDER BY started DESC, id DESC) AS n FROM runs) WHERE n = 1")
def w03_latest_run(t):
    return W.latest(t.runs.select("source", "id", "status", "started"), ["source"], "started", "id").drop("started")


_CUR = "SELECT id, extract(year FROM o.created) AS year, severity, kev_status = 'listed' AS listed, price AS score, created AS modified, sha256(CAST(id AS VARCHAR)) AS content_hash FROM items o"


@query(f"WITH c AS ({_CUR}), r AS (SELECT *, row_number() OVER (PARTITION BY year, severity ORDER BY NOT listed, score DESC, modified DESC, id) AS n FROM c WHERE severity IS NOT NULL) SELECT id, CAST(year AS INT) AS year, severity, CAST(n AS INT) AS rank FROM r WHERE n <= CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 2 END")
def w04_curated(t):
    c = t.items.select("id", F.year("created").alias("year"), "severity", (F.col("kev_status") == "listed").alias("listed"), F.col("price").alias("score"), F.col("created").alias("modified"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    return W.curated(c).select("id", "year", "severity", "rank")


@query("WITH c AS (SELECT owner, id, kev_status = 'listed' AS listed, price AS score, created AS modified, sha256(CAST(id AS VARCHAR)) AS content_hash FROM items) SELECT owner, id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY NOT listed, score DESC, modified DESC, content_hash) AS n FROM c) WHERE n = 1")
def w05_preferred_duplicate(t):
    c = t.items.select("owner", "id", (F.col("kev_status") == "listed").alias("listed"), F.col("price").alias("score"), F.col("created").alias("modified"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    return W.preferred_duplicates(c, "owner").select("owner", "id")


@query("""WITH v AS (SELECT owner AS id, created AS modified, CASE WHEN owner % 20 = 0 THEN item_type ELSE 'malware' END AS type, TIMESTAMP '1995-01-01' AS created, 'c' AS creator, id % 29 = 0 AS revoked, CAST(id AS VARCHAR) AS payload FROM items),
l AS (SELECT id, max(modified) AS m FROM v GROUP BY id)
SELECT v.id, count(*) AS versions, count(DISTINCT modified) = count(*) AND count(DISTINCT type) = 1 AND (min(CASE WHEN revoked THEN modified END) IS NULL OR min(CASE WHEN revoked THEN modified END) = max(m)) AS lineage_holds, max(modified) AS modified FROM v JOIN l ON v.id = l.id GROUP BY v.id""")
def w06_latest_versions(t):
    v = t.items.select(F.col("owner").alias("id"), F.col("created").alias("modified"), F.when(F.col("owner") % 20 == 0, F.col("item_type")).otherwise("malware").alias("type"), F.expr("timestamp_ntz'1995-01-01 00:00:00'").alias("created"), F.lit("c").alias("creator"), (F.col("id") % 29 == 0).alias("revoked"), F.col("id").cast("string").alias("payload"))
    return W.latest_versions(v).select("id", "versions", "lineage_holds", "modified")


@query("SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY started, id) AS n, count(*) OVER (PARTITION BY source) AS c FROM runs) WHERE n <= c - 60 + 1")
def w07_evicted(t):
    return W.over_limit(t.runs, "source", "started", "id", 60).select("source", "id")
