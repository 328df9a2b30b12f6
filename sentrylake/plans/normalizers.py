"""Normalisers over columns of whole tables. Each query writes texts out of a table's rows in SQL that Spark and DuckDB both
read, normalises them, and is held against SQL over the same rows; their odd cases are fixtures of the tests."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ioc, relevance, text, times, urls
from ..functions import observables as O
from ..functions import vulnerabilities as V
from ..sources import feeds, registry
from ..streaming import progress
from .analogues import query, shared_folder


def over(name: str, table: str, given: str, expected: dict[str, str], f: Callable[[Column], dict[str, Column]], key: str = "id") -> None:
    """A query of f over `given`, an expression of a table's columns; `expected` are SQL expressions of the key and given."""

    def run(t):
        rows = getattr(t, table).select(key, F.expr(given).alias("given"))
        return rows.select(key, *(c.alias(n) for n, c in f(F.col("given")).items()))

    run.__name__ = name
    query(f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in expected.items())} FROM (SELECT {key}, {given} AS given FROM {table})")(run)


_ID = "CAST(id AS STRING)"
_SPACES = r"trim(regexp_replace({}, '[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_FLAT = _SPACES.format("given")

over("x201_like_escape", "items", "concat(title, CASE WHEN id % 3 = 0 THEN chr(92) ELSE '' END)", {"escaped": "replace(replace(replace(given, chr(92), concat(chr(92), chr(92))), '%', concat(chr(92), '%')), '_', concat(chr(92), '_'))"}, lambda c: {"escaped": text.like_escaped(c)})
over("x203_bounded_text", "publications", "text", {"required": f"CASE WHEN length({_FLAT}) BETWEEN 1 AND 500 THEN {_FLAT} END", "optional": f"md5(nullif(left({_FLAT}, 500), ''))"}, lambda c: {"required": text.required(c, 500), "optional": F.md5(text.optional(c, 500))})
over("x204_unsafe", "publications", "CASE WHEN id % 2 = 0 THEN text ELSE concat(source, lang) END", {"unsafe": r"regexp_matches(given, '[\x00-\x1f\x7f-\x{9f}]')"}, lambda c: {"unsafe": text.unsafe(c)})
over("x206_canonical_url", "listings", "concat(replace(split_part(split_part(url, '#', 1), '?', 1), '://', '://WWW.'), '?utm_source=z&b=', CAST(page_id AS STRING), '&a=1&gclid=9#part')", {"canonical": "CASE WHEN given LIKE 'https:%' THEN concat(replace(split_part(given, '?', 1), '://WWW.', '://www.'), '?a=1&b=', CAST(page_id AS VARCHAR)) END"}, lambda c: {"canonical": urls.canonical_url(c)}, "page_id")
over("x209_safe_payload", "runs", """concat('{"token": "x", "b": [1, {"Api-Key": 2}], "k": ', CAST(id AS STRING), '}')""", {"safe": """concat('{"b":[1,{}],"k":', CAST(id AS VARCHAR), '}')"""}, lambda c: {"safe": text.safe_payload(c)})
over("x210_security_key", "people", "concat(' ', name, '-_', segment)", {"key": "lower(regexp_replace(given, '[^A-Za-z0-9]', '', 'g'))"}, lambda c: {"key": text.security_key(c)})
over("x211_plain_text", "publications", "concat('<div><p>', lang, ' &amp;  ', CAST(id AS STRING), '</p><script>var x = \"', source, '\"</script><style>p{}</style><b>', source, '</b></div>')", {"plain": "concat(regexp_extract(given, '<p>(..) ', 1), ' & ', CAST(id AS VARCHAR), ' ', regexp_extract(given, '<b>(.*?)</b>', 1))"}, lambda c: {"plain": text.plain_text(c)})
over("x213_timestamps", "runs", "CASE id % 4 WHEN 0 THEN concat(CAST(CAST(started AS DATE) AS STRING), 'T03:04:05Z') WHEN 1 THEN concat(CAST(CAST(started AS DATE) AS STRING), 'T03:04:05+04:00') WHEN 2 THEN concat(CAST(CAST(started AS DATE) AS STRING), 'T03:04:05') ELSE 'Tue, 02 Jan 2024 03:04:05 GMT' END", {"seconds": "CASE id % 4 WHEN 0 THEN CAST(epoch(CAST(left(given, 10) AS TIMESTAMP)) AS BIGINT) + 11045 WHEN 1 THEN CAST(epoch(CAST(left(given, 10) AS TIMESTAMP)) AS BIGINT) - 3355 WHEN 3 THEN 1704164645 END", "naive": "CASE WHEN id % 4 = 2 THEN CAST(epoch(CAST(left(given, 10) AS TIMESTAMP)) AS BIGINT) + 11045 END"}, lambda c: {"seconds": F.unix_seconds(times.parsed_timestamp(c)), "naive": F.when(F.col("id") % 4 == 2, F.unix_seconds(times.parsed_timestamp(c, True)))})
over("x214_strict_date", "items", "CASE id % 3 WHEN 0 THEN CAST(CAST(created AS DATE) AS STRING) WHEN 1 THEN concat(CAST(CAST(created AS DATE) AS STRING), 'x') ELSE concat(left(CAST(CAST(created AS DATE) AS STRING), 4), '-02-30') END", {"day": "CASE WHEN id % 3 = 0 THEN given END"}, lambda c: {"day": times.strict_date(c).cast("string")})
over("x215_cve_id", "identifiers", "CASE WHEN item_id % 5 = 0 THEN replace(value, '-2099', '-99') ELSE concat(' ', lower(value), ' ') END", {"cve": "CASE WHEN item_id % 5 > 0 THEN upper(trim(given)) END"}, lambda c: {"cve": V.cve_id(c)}, "item_id")
over("x221_probability", "items", "CASE id % 5 WHEN 0 THEN concat('0.', lpad(CAST(id % 10000000 AS STRING), 7, '0')) WHEN 1 THEN '1.0' WHEN 2 THEN concat('1.', CAST(id + 1 AS STRING)) WHEN 3 THEN concat('p', CAST(id AS STRING)) ELSE concat('-0.', CAST(id AS STRING)) END", {"p": "CASE id % 5 WHEN 0 THEN CAST(floor(CAST(split_part(given, '.', 2) AS BIGINT) / 10 + 0.5) / 1000000 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) END"}, lambda c: {"p": V.probability(c).cast("double")})
over("x224_path_identity", "publications", "concat('https://cert.example.org/', CASE WHEN id % 3 = 0 THEN source ELSE concat('alerte/CERTFR-2024-ALE-', lpad(CAST(id % 1000 AS STRING), 3, '0')) END, '/')", {"identity": "CASE WHEN id % 3 > 0 THEN concat('CERTFR-2024-ALE-', lpad(CAST(id % 1000 AS VARCHAR), 3, '0')) END"}, lambda c: {"identity": urls.notice_id(c)})
over("x226_external_id", "publications", "concat('https://v.example.org/blog/', source, '-', CAST(id AS STRING), CASE WHEN id % 2 = 0 THEN '/' ELSE '' END)", {"external_id": "concat('v:', regexp_extract(given, '([^/]*)/?$', 1))"}, lambda c: {"external_id": urls.external_id(c, "v")})
over("x227_ip", "people", "CASE id % 4 WHEN 0 THEN concat(CAST(id % 256 AS STRING), '.0.2.', CAST(id % 100 AS STRING)) WHEN 1 THEN concat('2001:DB8:0::', CAST(id % 9 + 1 AS STRING)) WHEN 2 THEN concat('0', CAST(id % 9 AS STRING), '.1.2.3') ELSE concat(CAST(id AS STRING), '.1.2') END", {"v4": "CASE WHEN id % 4 = 0 THEN given END", "v6": "CASE WHEN id % 4 = 1 THEN concat('2001:db8::', CAST(id % 9 + 1 AS VARCHAR)) END"}, lambda c: {"v4": O.ipv4(c), "v6": O.ipv6(c)})
over("x228_domain", "people", "CASE id % 5 WHEN 0 THEN concat('Host-', CAST(id AS STRING), '.Example') WHEN 1 THEN concat('a_', CAST(id AS STRING), '.com') WHEN 2 THEN concat('Bücher.Host', CAST(id AS STRING), '.example') WHEN 3 THEN concat('x.', CAST(id AS STRING)) ELSE concat('A', CAST(id AS STRING), '.co.') END", {"domain": "CASE id % 5 WHEN 0 THEN lower(given) WHEN 2 THEN concat('xn--bcher-kva.host', CAST(id AS VARCHAR), '.example') WHEN 4 THEN concat('a', CAST(id AS VARCHAR), '.co') END"}, lambda c: {"domain": O.domain(c)})
over("x229_url", "people", "CASE id % 4 WHEN 0 THEN concat('HTTPS://User', CAST(id AS STRING), '.Co:443/%7ea?b=', CAST(id AS STRING), '#c') WHEN 1 THEN concat('ftp://a', CAST(id AS STRING), '.co/') WHEN 2 THEN concat('http://a', CAST(id AS STRING), '.co') ELSE concat('http://a.co:', CAST(id % 60000 + 1000 AS STRING), '/x') END", {"url": "CASE id % 4 WHEN 0 THEN concat('https://user', CAST(id AS VARCHAR), '.co/%7Ea?b=', CAST(id AS VARCHAR)) WHEN 2 THEN concat(given, '/') WHEN 3 THEN given END"}, lambda c: {"url": O.url(c)})
over("x230_file_hash", "publications", "CASE id % 3 WHEN 0 THEN upper(md5(text)) WHEN 1 THEN left(md5(text), 31) ELSE concat(md5(text), md5(source)) END", {"hash": "CASE WHEN id % 3 <> 1 THEN lower(given) END", "algorithm": "CASE id % 3 WHEN 0 THEN 'md5' WHEN 2 THEN 'sha256' END"}, lambda c: {"hash": O.file_hash(c), "algorithm": O.hash_algorithm(O.file_hash(c))})
over("x232_refang", "people", "CASE id % 3 WHEN 0 THEN concat('hxxp://evil', CAST(id AS STRING), '[.]co/a') WHEN 1 THEN concat('hxxps[:]//a', CAST(id AS STRING), '(.)co') ELSE concat('a[.]b', CAST(id AS STRING), '(.)c') END", {"plain": "CASE id % 3 WHEN 0 THEN concat('http://evil', CAST(id AS VARCHAR), '.co/a') WHEN 1 THEN concat('https://a', CAST(id AS VARCHAR), '.co') END"}, lambda c: {"plain": O.refanged(c)})
over("x235_context", "publications", "text", {"context": f"md5(left({_FLAT}, 500))"}, lambda c: {"context": F.md5(text.snippet(c))})
over("x236_stix_pattern", "people", "CASE id % 3 WHEN 0 THEN concat('[ipv4-addr:value = ''192.0.2.', CAST(id % 256 AS STRING), ''']') WHEN 1 THEN concat('[file:hashes.''SHA-256'' = ''', md5(name), ''']') ELSE concat('[a:b = ', CAST(id AS STRING), '] OR [c:d = 2]') END", {"kind": "CASE id % 3 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'file_hash' END", "algorithm": "CASE WHEN id % 3 = 1 THEN 'sha256' END", "value": "CASE WHEN id % 3 < 2 THEN regexp_extract(given, '= ''([^'']*)''', 1) END"}, lambda c: {k: O.from_pattern(c)[k] for k in ("kind", "algorithm", "value")})
over("x237_alias", "people", "concat(' ', name, '  ', segment)", {"same": "true", "other": "false"}, lambda c: {"same": text.alias_identity(c) == text.alias_identity(F.upper(F.concat(F.col("given"), F.lit(" ")))), "other": text.alias_identity(c) == text.alias_identity(F.concat(c, F.lit("x")))})
over("x244_csv_cell", "items", "CASE id % 4 WHEN 0 THEN concat('=', title) WHEN 1 THEN concat('  @', title) WHEN 2 THEN title END", {"cell": "CASE id % 4 WHEN 0 THEN concat('''', given) WHEN 1 THEN concat('''', given) WHEN 2 THEN given ELSE '' END"}, lambda c: {"cell": text.neutral_cell(c)})
over("x248_diagnostics", "runs", "concat('run ', CAST(id AS STRING), chr(10), 'failed:  password=', status, CAST(id AS STRING), chr(9), 'api-key: k', CAST(source AS STRING), ' end')", {"safe": "concat('run ', CAST(id AS VARCHAR), ' failed: password=[redacted] api-key: [redacted] end')"}, lambda c: {"safe": text.sanitized(c)})
over("x250_markup_guard", "publications", "CASE id % 4 WHEN 0 THEN concat(source, ' &amp;lt;b&amp;gt; ', lang) WHEN 1 THEN concat(source, ' < ', lang) WHEN 2 THEN concat(source, '&lt;i&gt;', lang) ELSE concat(source, ' &amp; ', lang) END", {"allowed": "id % 2 = 1"}, lambda c: {"allowed": text.free_of_markup(c)})
over("x246_slots", "runs", "date_trunc('hour', started) + CASE WHEN id % 3 = 0 THEN INTERVAL 16 MINUTE ELSE INTERVAL 17 MINUTE END", {"ok": "extract(hour FROM given) % 2 = 0 AND id % 3 > 0"}, lambda c: {"ok": times.slot_valid(c.cast("timestamp_ntz"))})


@query("SELECT id, CASE WHEN id % 3 = 2 THEN concat('g', CAST(id AS VARCHAR)) ELSE concat('https://x.example.org/', CAST(id AS VARCHAR)) END AS external_id FROM publications")
def x212_entry_fields(t):
    i = F.col("id").cast("string")
    rows = t.publications.select("id", F.when(F.col("id") % 3 == 0, " ").when(F.col("id") % 3 == 2, F.concat(F.lit("g"), i, F.lit(" "))).alias("guid"), F.concat(F.lit(" https://x.example.org/"), i).alias("link"))
    return rows.select("id", feeds.entry_id("guid", "link").alias("external_id"))


@query(f"SELECT id, CASE WHEN id % 7 > 0 THEN concat('A ', CAST(id AS VARCHAR)) END AS title, concat('https://x.example.org/', CAST(id AS VARCHAR)) AS link, concat(source, ' & ', lang) AS summary, TIMESTAMP '2024-01-02 03:04:05' AS published FROM publications")
def x223_rss_entry(t):
    i = F.col("id").cast("string")
    raw = t.publications.select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit(" A  "), i)).otherwise(" ").alias("title"), F.concat(F.lit("https://x.example.org/"), i, F.lit(" ")).alias("link"), F.lit(None).cast("string").alias("guid"), F.concat(F.lit("<p>"), "source", F.lit("</p> &amp; "), "lang").alias("description"), F.lit("Tue, 02 Jan 2024 03:04:05 GMT").alias("pubDate"))
    return feeds.normalized_entries(raw, "id").select("id", "title", "link", "summary", F.to_timestamp_ntz(F.date_format("published", "yyyy-MM-dd HH:mm:ss")).alias("published"))


_ENTRY = """named_struct('cveID', concat('cve-2099-', CAST(10000 + id AS STRING)), 'vendorProject', 'v', 'product', 'p', 'vulnerabilityName', title, 'dateAdded', CASE WHEN id % 13 = 0 THEN 'soon' ELSE CAST(CAST(created AS DATE) AS STRING) END, 'shortDescription', severity, 'requiredAction', ' act ', 'dueDate', CASE WHEN id % 4 = 0 THEN '2024-13-01' ELSE '2024-02-01' END, 'knownRansomwareCampaignUse', CASE id % 3 WHEN 0 THEN 'Known' WHEN 1 THEN ' unknown' ELSE '' END)"""


@query("SELECT id, concat('CVE-2099-', CAST(10000 + id AS VARCHAR)) AS cve_id, title, severity AS summary, CASE WHEN id % 13 > 0 THEN CAST(CAST(created AS DATE) AS VARCHAR) END AS added, CASE WHEN id % 4 > 0 THEN '2024-02-01' END AS due, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ransomware FROM items")
def x220_catalog_entries(t):
    out = t.items.select("id", F.expr(_ENTRY).alias("e")).select("id", *V.normalized_catalog_entry("e"))
    return out.select("id", "cve_id", "title", "summary", F.col("date_added").cast("string").alias("added"), F.col("due_date").cast("string").alias("due"), "ransomware")


def _catalogs(t):
    """A catalog of each owner's items, some without a version, with another count, or an entry that is not valid."""
    lists = t.items.groupBy("owner").agg(F.collect_list(F.expr(_ENTRY)).alias("vulnerabilities"))
    k = F.col("owner") % 5
    return lists.select("owner", F.when(k == 1, " ").otherwise("2024.01").alias("catalogVersion"), F.when(k == 2, "2024-01-01").otherwise("2024-01-01T00:00:00Z").alias("dateReleased"), (F.size("vulnerabilities") + F.when(k == 3, 1).otherwise(0)).cast("long").alias("count"), "vulnerabilities")


_COMPLETE = "SELECT owner, owner % 5 NOT IN (1, 2, 3) AND bool_and(id % 13 > 0) AS complete FROM items GROUP BY owner"


@query(_COMPLETE)
def x222_catalog_complete(t):
    return V.catalog_complete(_catalogs(t)).select("owner", "complete")


@query(f"SELECT concat('CVE-2099-', CAST(10000 + id AS VARCHAR)) AS cve_id, title FROM items JOIN ({_COMPLETE}) USING (owner) WHERE complete")
def s05_catalog_file(t):
    # catalog files, one for each owner modulo fifty, of that owner's entries
    root = shared_folder(t, "catalogs")
    _catalogs(t).repartition(8, "owner").drop("owner").write.json(root)
    lines = t.spark.read.schema("catalogVersion string, dateReleased string, count long, vulnerabilities array<" + V.CATALOG + ">").json(root)
    return feeds.catalog_entries(V.catalog_complete(lines)).select("cve_id", "title")


@query("SELECT CAST(id // 30 AS BIGINT) AS file, concat('A ', CAST(id AS VARCHAR)) AS title, lang AS summary FROM publications WHERE id // 30 % 5 NOT IN (1, 2, 3)")
def s10_publication_files(t):
    # files of thirty records: some of another version, with a repeated key, or cut
    one = F.to_json(F.struct(F.concat(F.lit(" A  "), F.col("id").cast("string")).alias("title"), F.lit("https://v.example.com/1").alias("url"), F.concat("lang", F.lit(" ")).alias("summary"), F.lit("2024-01-01T00:00:00Z").alias("published_at")))
    whole = t.publications.groupBy(F.floor(F.col("id") / 30).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("x")))), lambda x: x["x"]), ",").alias("body"))
    k = F.col("file") % 5
    head = F.when(k == 1, '{"schema_version": 2, "source_slug": "').when(k == 2, '{"schema_version": 1, "schema_version": 1, "source_slug": "').otherwise('{"schema_version": 1, "source_slug": "')
    body = F.concat(head, F.col("file").cast("string"), F.lit('", "publications": ['), "body", F.when(k == 3, "").otherwise("]}"))
    root = shared_folder(t, "publications")
    # some to a stored file, as files of their own would grow with the publications
    whole.select(body.alias("value")).write.parquet(root)
    return feeds.publications_of(t.spark.read.schema("value string").parquet(root)).select(F.col("source").cast("long").alias("file"), "title", "summary")


def _registry(t):
    k = F.col("id")
    return t.sources.select("slug", F.when(k % 2 == 0, "public").otherwise("cert").alias("vendor"), F.concat(F.lit("https://new.example.org/"), "slug").alias("base_url"), (k % 3 > 0).alias("enabled"), (k % 5 > 0).alias("implemented"))


@query("SELECT slug, CASE WHEN id % 2 = 0 THEN 'public' ELSE 'cert' END AS vendor FROM sources WHERE id % 3 > 0 AND id % 5 > 0")
def s14_usable_sources(t):
    return registry.usable(_registry(t)).select("slug", "vendor")


@query("SELECT slug, CASE id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'conflict' ELSE 'conflict' END AS outcome FROM sources UNION ALL SELECT concat('old-', slug), 'unregistered' FROM sources WHERE id % 6 = 0")
def s17_catalog_bootstrap(t):
    known = t.sources.where("id % 4 > 0").select("slug", F.when(F.col("id") % 4 == 1, F.concat(F.lit("https://new.example.org/"), "slug")).otherwise(F.concat(F.lit("https://else.example.org/"), "slug")).alias("base_url"))
    gone = t.sources.where("id % 6 = 0").select(F.concat(F.lit("old-"), "slug").alias("slug"), F.lit("x").alias("base_url"))
    return registry.bootstrap(_registry(t), known.unionByName(gone))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN concat('T', lpad(CAST(id % 10000 AS VARCHAR), 4, '0'), '.001') END AS attack_id FROM indicators")
def x238_attack_id(t):
    # one good reference, a malformed one, or two
    number = F.concat(F.lit("T"), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0"))
    ref = lambda source, x: F.struct(F.lit(source).alias("source_name"), x.alias("external_id"))
    k = F.col("id") % 3
    refs = F.when(k == 0, F.array(ref("x", F.lit("y")), ref("mitre-attack", F.concat(number, F.lit(".001"))))).when(k == 1, F.array(ref("mitre-attack", F.lit("T1")), ref("x", F.lit("y")))).otherwise(F.array(ref("mitre-attack", number), ref("mitre-attack", number)))
    return t.indicators.select("id", O.attack_id(refs).alias("attack_id"))


@query("SELECT id, kind, value, form, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT id, unnest([{'k': 'domain', 'v': concat('bad', CAST(id AS VARCHAR), '.co'), 'f': 'literal', 'c': 0.78}, {'k': 'ipv4', 'v': concat('8.8.', CAST(id % 200 + 1 AS VARCHAR), '.', CAST(id % 250 + 1 AS VARCHAR)), 'f': 'literal', 'c': 0.82}, CASE WHEN id % 3 = 0 THEN {'k': 'url', 'v': concat('http://evil', CAST(id AS VARCHAR), '.co/a'), 'f': 'defanged', 'c': 0.95} END, CASE WHEN id % 4 = 1 THEN {'k': 'url', 'v': concat('https://own', CAST(id AS VARCHAR), '.co/post'), 'f': 'literal', 'c': 0.90} END]) AS x FROM people) q, LATERAL (SELECT x.k AS kind, x.v AS value, x.f AS form, x.c AS confidence) WHERE kind IS NOT NULL")
def x233_own_source(t):
    # each text names its own page and host, which are no indicators of it; one in four texts has no exclusions
    i = F.col("id").cast("string")
    own = F.concat(F.lit("https://own"), i, F.lit(".co/post"))
    summary = F.concat(F.lit("See "), own, F.lit(" . Contacted domain bad"), i, F.lit(".co and IP address 8.8."), (F.col("id") % 200 + 1).cast("string"), F.lit("."), (F.col("id") % 250 + 1).cast("string"), F.lit(" today"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(" via hxxp://evil"), i, F.lit("[.]co/a"))).otherwise(""))
    texts = t.people.select("id", F.lit("Report").alias("title"), summary.alias("summary"))
    exclusions = t.people.where("id % 4 <> 1").select("id", F.concat(F.lit("HTTPS://OWN"), i, F.lit(".CO/post#top")).alias("url"), F.lit(None).cast("string").alias("host"))
    return ioc.extract(texts, exclusions=exclusions).select("id", "kind", "value", "form", F.col("confidence").cast("double").alias("confidence"))


#: Candidates of each person: kind, value, form, what stands before, what is near, and by SQL whether it counts. Addresses run
#: over all first bytes; those of networks that are not public, and from 224 on, do not count.
_NUMBER = "CAST(id % 250 + 1 AS STRING)"
_OUTER = "id % 250 + 1 NOT IN (10, 127) AND id % 250 + 1 < 224"
_CANDIDATES = [
    ("url", f"concat('https://a', {_ID}, '.co/x')", "literal", "", "", "true"),
    ("url", f"concat('https://', {_NUMBER}, '.9.9.9/', {_ID})", "literal", "", "", _OUTER),
    ("url", f"concat('https://a', {_ID}, '.example.org/')", "defanged", "", "", "false"),
    ("ipv4", f"concat({_NUMBER}, '.9.9.9')", "literal", "", " address", _OUTER),
    ("ipv4", f"concat({_NUMBER}, '.9.9.9')", "literal", "", " nothing", "false"),
    ("ipv4", f"concat({_NUMBER}, '.9.9.9')", "literal", "version ", "version  address", "false"),
    ("ipv4", f"concat({_NUMBER}, '.9.9.9')", "defanged", "", "", _OUTER),
    ("ipv4", f"concat('192.168.1.', {_NUMBER})", "defanged", "", "", "false"),
    ("domain", f"concat('a', {_ID}, '.co')", "literal", "domain ", "domain  x", "true"),
    ("domain", f"concat('a', {_ID}, '.co')", "literal", "import ", "import  domain", "false"),
    ("domain", f"concat('setup', {_ID}, '.exe')", "defanged", "", "", "false"),
    ("domain", f"concat('a', {_ID}, '.test')", "defanged", "", "", "false"),
    ("file_hash", "repeat(CAST(id % 10 AS STRING), 32)", "literal", "md5 ", "md5 ", "false"),
    ("file_hash", f"md5({_ID})", "literal", "md5 ", "md5 ", "true"),
    ("file_hash", f"md5({_ID})", "literal", "", "", "false"),
]


@query("SELECT id, unnest(x, recursive := true) FROM (SELECT id, unnest([" + ", ".join(f"{{'kind': '{k}', 'value': {v}, 'form': '{f}', 'before': '{b}', 'near': '{n}', 'accepted': {ok}}}" for k, v, f, b, n, ok in _CANDIDATES) + "]) AS x FROM people)")
def x234_acceptance(t):
    each = ", ".join(f"struct('{k}' AS kind, {v} AS value, '{f}' AS form, '{b}' AS before, '{n}' AS near)" for k, v, f, b, n, _ in _CANDIDATES)
    rows = ioc.spread(t.people.select("id"), "id").selectExpr("id", f"inline(array({each}))")
    return ioc.accepted(rows).select("id", "kind", "value", "form", "before", "near", "accepted")


@query("SELECT id, array_to_string(list_filter(['uae-authority-desc', CASE WHEN id % 2 = 0 THEN 'uae-emirate-dubai' END, 'language-english', CASE WHEN id % 3 = 0 THEN 'uae-sector-aviation-transport' END, CASE WHEN id % 5 = 0 THEN 'uae-sector-financial-services' END], lambda x: x IS NOT NULL), ',') AS tags FROM people")
def x243_evidence_tags(t):
    k = F.col("id")
    title = F.concat(F.lit("Notice"), F.when(k % 2 == 0, " from Dubai").otherwise(""), F.when(k % 3 == 0, " airport").otherwise(""), F.when(k % 5 == 0, " bank").otherwise(""))
    return t.people.select("id", F.array_join(relevance.tags(title, F.lit(None).cast("string"), F.lit("desc-news")), ",").alias("tags"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'malware' ELSE 'tool' END AS type, id % 2 = 0 AS accepted FROM indicators")
def x249_staged_object(t):
    body = F.to_json(F.struct(F.col("value").alias("x_name"), F.when(F.col("id") % 2 == 0, "malware").otherwise("tool").alias("type")))
    return feeds.staged(t.indicators.select("id", body.alias("payload")), "payload").select("id", "type", "accepted")


@query("""WITH RECURSIVE v AS (SELECT owner, sha256(CAST(id AS VARCHAR)) AS h, id AS k FROM items), a AS (SELECT owner AS source, k, concat(CAST(k AS VARCHAR), ':', sha256(h)) AS h FROM v),
b AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, ',' ORDER BY k, h)) AS h FROM a GROUP BY source, a.k // 1000), c AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, ',' ORDER BY k, h)) AS h FROM b GROUP BY source, b.k // 1000),
d AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, ',' ORDER BY k, h)) AS h FROM c GROUP BY source, c.k // 1000) SELECT source AS id, sha256(string_agg(h, ',' ORDER BY k, h)) AS document_hash FROM d GROUP BY source""")
def x251_document_tree(t):
    v = t.items.select("owner", "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    return progress.feed_digests(v, "owner", "id", "h").select(F.col("source").alias("id"), F.col("digest").alias("document_hash"))


@query("WITH b AS (SELECT min(created) AS a FROM items) SELECT id, CAST(date_diff('day', a, created) // 100 AS INT) AS chunk FROM items, b")
def x245_date_chunks(t):
    # the chunks of the items' whole span: each item is in one
    first, last = t.items.agg(F.min("created"), F.max("created")).first()
    chunks = times.date_chunks(t.spark, first, last + timedelta(days=1), 100).withColumnsRenamed({"first": "begins", "last": "ends"})
    # joined by year, so that no item is held against all chunks
    chunks = chunks.withColumn("year", F.explode(F.sequence(F.year("begins"), F.year("ends"))))
    inside = (F.year("created") == F.col("year")) & (F.col("created") >= F.col("begins")) & (F.col("created") <= F.col("ends"))
    return t.items.join(F.broadcast(chunks), inside).select("id", F.col("chunk").cast("int").alias("chunk"))  # some four rows a year
