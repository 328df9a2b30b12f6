"""Vulnerability feeds to columns: identifiers, descriptions, scores, catalog entries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import canonical_json_sha256, col, optional, required
from .times import parsed_timestamp, strict_date

_METRIC = "array<struct<cvssData:struct<version:string,vectorString:string,baseScore:decimal(3,1),baseSeverity:string>,baseSeverity:string>>"
FEED = f"cve struct<id:string,published:string,lastModified:string,vulnStatus:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV40:{_METRIC},cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>>"


def cve_id(c: str | Column) -> Column:
    x = F.upper(F.trim(col(c)))
    return F.when(x.rlike(r"^CVE-\d{4}-\d{4,}$"), x)


def english(descriptions: str | Column) -> Column:
    """The first English description that is not blank."""
    texts = F.transform(F.filter(col(descriptions), lambda d: d["lang"] == "en"), lambda d: F.trim(d["value"]))
    return F.try_element_at(F.filter(texts, lambda t: F.length(t) > 0), F.lit(1))


def best_score(metrics: str | Column) -> Column:
    """The first metric of the newest version that a record has; severity from its data, else its wrapper."""
    m = col(metrics)

    def first(name: str, version: str) -> Column:
        one = F.try_element_at(m.getField(name), F.lit(1))
        data = one["cvssData"]
        return F.when(
            data["baseScore"].isNotNull(),
            F.struct(F.coalesce(data["version"], F.lit(version)).alias("version"), data["baseScore"].alias("score"), data["vectorString"].alias("vector"), F.lower(F.coalesce(data["baseSeverity"], one["baseSeverity"])).alias("severity")),
        )

    return F.coalesce(first("cvssMetricV40", "4.0"), first("cvssMetricV31", "3.1"), first("cvssMetricV30", "3.0"), first("cvssMetricV2", "2.0"))


@F.pandas_udf(ArrayType(StringType()))
def affected_products(configurations: pd.Series) -> pd.Series:
    """Vulnerable criteria in nested configurations, depth first, each once; at most 100, at most 8 levels.
    Spark has no recursive schema, so the JSON is walked in Python."""

    def walk(node, depth, out):
        if depth > 8 or len(out) >= 100:
            return
        for m in node.get("cpeMatch") or ():
            if m.get("vulnerable") is True and m.get("criteria") and m["criteria"] not in out and len(out) < 100:
                out.append(m["criteria"])
        for key in ("nodes", "children"):
            for child in node.get(key) or ():
                walk(child, depth + 1, out)

    def one(text):
        out: list[str] = []
        try:
            for c in json.loads(text or "[]"):
                walk(c, 0, out)
        except (ValueError, AttributeError, TypeError):
            return None
        return out

    return configurations.map(one)


def normalized_feed(df: DataFrame) -> DataFrame:
    """Rows with column `json` (a feed record) to vulnerability columns; `valid` is false without an id or a time."""
    r = df.withColumn("r", F.from_json("json", FEED)).withColumn("products", affected_products(F.get_json_object("json", "$.cve.configurations")))
    s = best_score("r.cve.metrics")
    out = r.select(
        cve_id("r.cve.id").alias("cve_id"),
        english("r.cve.descriptions").alias("summary"),
        parsed_timestamp("r.cve.published", True).alias("published"),
        parsed_timestamp("r.cve.lastModified", True).alias("modified"),
        F.when(F.lower("r.cve.vulnStatus") == "rejected", "archived").otherwise("active").alias("status"),
        s.alias("s"),
        "products",
        canonical_json_sha256("json").alias("content_hash"),
    )
    return out.select("cve_id", "summary", "published", "modified", "status", F.coalesce("s.severity", F.lit("unknown")).alias("severity"), F.col("s.score").alias("score"), F.col("s.version").alias("score_version"), F.col("s.vector").alias("vector"), "products", "content_hash", (F.col("cve_id").isNotNull() & F.col("modified").isNotNull()).alias("valid"))


CATALOG = "struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string>"


def normalized_catalog_entry(c: str | Column) -> list[Column]:
    x = col(c)
    use = F.lower(F.trim(x["knownRansomwareCampaignUse"]))
    return [
        cve_id(x["cveID"]).alias("cve_id"),
        required(x["vulnerabilityName"], 500).alias("title"),
        optional(x["shortDescription"], 4000).alias("summary"),
        strict_date(x["dateAdded"]).alias("date_added"),
        strict_date(x["dueDate"]).alias("due_date"),
        optional(x["requiredAction"], 2000).alias("required_action"),
        F.when(use == "known", True).when(use == "unknown", False).alias("ransomware"),
    ]


def catalog_complete(catalogs: DataFrame) -> DataFrame:
    """Rows(catalogVersion, dateReleased, count, vulnerabilities) with whether the whole may be used: a version, a
    release time with an offset, the stated number of entries, and each of them valid."""
    valid = F.forall("vulnerabilities", lambda e: cve_id(e["cveID"]).isNotNull() & strict_date(e["dateAdded"]).isNotNull())
    return catalogs.withColumn("complete", F.coalesce((F.length(F.trim("catalogVersion")) > 0) & parsed_timestamp("dateReleased").isNotNull() & (F.size("vulnerabilities") == F.col("count")) & valid, F.lit(False)))


def probability(c: str | Column) -> Column:
    """A decimal of six places, halves up; null outside 0 to 1."""
    x = col(c).try_cast("decimal(38,18)")
    return F.when((x >= 0) & (x <= 1), x.cast("decimal(7,6)"))
