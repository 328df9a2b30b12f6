"""The library's tables, simulated over the driver's: each a projection in SQL that Spark and DuckDB both read.

The driver has no intelligence data, so orders stand for items, line items for source records, suppliers for
sources, events for runs, documents for publications. Only these inputs are shared with the oracle SQL; what a
query does with them is DataFrame code here and separate SQL there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[str]]] = {
    "items": (
        "orders",
        [
            "o_orderkey AS id",
            "o_custkey AS owner",
            "CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS status",
            "CASE o_orderkey % 6 WHEN 0 THEN 'vulnerability' WHEN 1 THEN 'advisory' WHEN 2 THEN 'news' WHEN 3 THEN 'report' WHEN 4 THEN 'official_alert' ELSE 'guide' END AS item_type",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS severity",
            "concat('Item ', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 9 = 0 THEN ' 50%_Off' ELSE ' 50 off' END) AS title",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS published",
            "o_orderdate AS created",
            "o_orderdate + INTERVAL 1 DAY AS collected",
            "CASE o_orderkey % 5 WHEN 0 THEN 'listed' WHEN 1 THEN 'unknown' ELSE 'not_listed' END AS kev_status",
            "CAST((o_orderkey % 1000) / 1000.0 AS DECIMAL(7,6)) AS epss",
            "CASE WHEN o_orderkey % 11 = 0 THEN 'confirmed' WHEN o_orderkey % 11 = 1 THEN 'probable' WHEN o_orderkey % 11 = 2 THEN 'possible' WHEN o_orderkey % 11 < 6 THEN 'not_relevant' ELSE 'unknown' END AS relevance",
            "CASE o_orderkey % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'uae' ELSE 'unknown' END AS scope",
            "CAST((o_orderkey % 120) / 100.0 AS DECIMAL(4,3)) AS confidence",
            "o_totalprice AS price",
        ],
    ),
    "records": (
        "lineitem",
        [
            "l_orderkey AS item_id",
            "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS record_id",
            "l_suppkey AS source_id",
            "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE concat('s', CAST(l_suppkey AS STRING)) END AS source",
            "l_linenumber = 1 AS is_primary",
            "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END AS external_id",
            "concat('https://r.example.org/', CAST(l_partkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS url",
            "l_shipdate AS seen",
            "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_shipdate END AS published",
            "l_partkey AS indicator_id",
            "CAST(l_discount AS DECIMAL(4,3)) AS confidence",
            "l_returnflag AS flag",
        ],
    ),
    "identifiers": (
        "lineitem",
        ["l_orderkey AS item_id", "CASE WHEN l_partkey % 2 = 0 THEN 'cve' ELSE 'vendor' END AS namespace", "concat('CVE-2099-', CAST(10000 + l_partkey AS STRING)) AS value", "l_linenumber = 1 AS is_primary"],
    ),
    "sources": ("supplier", ["s_suppkey AS id", "s_name AS slug", "s_nationkey AS nation", "s_acctbal AS balance"]),
    "indicators": ("part", ["p_partkey AS id", "p_name AS value", "p_brand AS entity", "p_type AS kind", "CASE WHEN p_size % 4 = 0 THEN 'revoked' ELSE 'active' END AS status", "p_size % 3 = 0 AS revoked"]),
    "people": ("customer", ["c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_nationkey AS nation", "c_acctbal AS balance"]),
    "edges": ("lineitem", ["l_partkey % 400 AS source", "l_suppkey + 0 AS target", "l_returnflag AS kind"]),
    "runs": (
        "events",
        [
            "event_id AS id",
            "user_id AS source",
            "event_id % 700 AS cycle",
            "event_id % 4 AS attempt",
            "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'no_change' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'failed' ELSE 'running' END AS status",
            "ts AS started",
            "CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 50 = 0 THEN ts - INTERVAL 5 SECOND ELSE ts + INTERVAL 90 SECOND END AS finished",
            "value",
            "props",
        ],
    ),
    "errors": ("events", ["event_id + 1 AS run_id", "event_id % 2 = 0 AS retryable", "event_type"]),
    "turns": ("conversations", ["conv_id AS run", "turn AS sequence", "role AS state", "text"]),
    "publications": ("documents", ["doc_id AS id", "text", "source", "lang", "n_chars"]),
    "listings": ("pages", ["page_id", "url", "html"]),
    "marks": ("labels", ["doc_id AS id", "quality", "toxic"]),
    "terms": ("benchmark", ["item_id AS id", "text"]),
}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Cases made by hand, which the tests run; they read no table and are no queries.
FIXTURES: dict = {}
FIXTURE_ORACLES: dict[str, str] = {}


class Tables:
    """The simulated tables of one data folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table, columns = TABLES[name]
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet").selectExpr(*columns)

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")


def shared_folder(t: Tables, name: str) -> str:
    """A new folder that the driver and all executors see; the warehouse serves only where all run on one machine."""
    root = t.spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not t.spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = t.spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/sentrylake-{name}-{uuid.uuid4().hex}"


def _with(sql: str) -> str:
    used = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} AS (SELECT {', '.join(TABLES[n][1])} FROM {TABLES[n][0]})" for n in used]
    body = sql.strip()
    head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    if body.upper().startswith(head):
        return head + ", ".join([*parts, body[len(head) :]]) if parts else body
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def query(sql: str | None = None):
    """Registers a function of the tables under its name, with its oracle."""

    def made(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = _with(sql)
        return f

    return made


def fixture(sql: str):
    """Keeps a function of made rows for the tests, with what must come out."""

    def made(f):
        FIXTURES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        FIXTURE_ORACLES[f.__name__] = _with(sql)
        return f

    return made
