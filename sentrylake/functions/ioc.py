"""Indicator extraction from titles and summaries, as a Spark job over candidate rows.

A pandas UDF only finds where the patterns match; whether a match counts (syntax, public addresses,
reserved hosts, versions, file names, nearby words, matches within other matches, caps) is decided by
columns and windows over the candidates, of which a text has at most TOTAL.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import observables as O

# Fixed values of the extraction: patterns, caps, windows, word lists, confidences.
PATTERNS = {
    "url": r"(?i)\b(?:https?|hxxps?)(?::|\[:\])//[^\s<>\"']+",
    "ipv4": r"(?<![\w.])(?:[0-9]{1,3}(?:\.|\[\.\]|\(\.\))){3}[0-9]{1,3}(?![\w.])",
    "ipv6": r"(?<![\w:])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![\w:])",
    "file_hash": r"(?<![0-9a-fA-F])(?:[0-9a-fA-F]{128}|[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![0-9a-fA-F])",
    "domain": r"(?<![@\w-])(?:[A-Za-z0-9\u0080-\uffff](?:[A-Za-z0-9\u0080-\uffff-]{0,61}[A-Za-z0-9\u0080-\uffff])?(?:\.|\[\.\]|\(\.\))){1,}[A-Za-z0-9\u0080-\uffff](?:[A-Za-z0-9\u0080-\uffff-]{0,61}[A-Za-z0-9\u0080-\uffff])?(?![\w.-])",
}
#: What a text must hold for a pattern to be worth trying; plain prose holds none of it.
TRIGGERS = {"url": r"//", "ipv4": r"[0-9](?:\.|\[\.\]|\(\.\))[0-9]", "ipv6": r"[0-9a-fA-F]{0,4}:[0-9a-fA-F]{0,4}:", "file_hash": r"[0-9a-fA-F]{32}", "domain": r"[A-Za-z0-9\u0080-\uffff](?:\.|\[\.\]|\(\.\))[A-Za-z0-9\u0080-\uffff]"}
CAPS = {"url": 20, "ipv4": 25, "ipv6": 20, "file_hash": 20, "domain": 25}
TOTAL, LONGEST, NEAR, SNIPPET = 100, 12_000, 120, 500
WORDS = {
    "ipv4": r"(?i)\b(?:ioc|indicator|observable|malicious|command[- ]and[- ]control|c2|ip|address|host)\b",
    "domain": r"(?i)\b(?:ioc|indicator|observable|malicious|command[- ]and[- ]control|c2|domain|host)\b",
    "file_hash": r"(?i)\b(?:ioc|indicator|observable|malicious|hash|md5|sha-?1|sha-?256|sha-?512)\b",
}
RESERVED = r"(?i)(?:^|\.)example\.(?:com|net|org)$|^localhost$|\.(?:example|invalid|local|localhost|internal|lan|home|corp|test)$"
FILES = r"(?i)\.(?:exe|dll|zip|tar|gz|js|py|json|xml|pdf|doc|docx|rpm|deb|yaml|yml|bin)$"
VERSION = r"(?i)(?:\b(?:version|release|build)\s*:?\s*|\bv)$"
NAMED = r"(?i)\b(?:domain|host|c2|url)\s*:?\s*$"
UNNAMED = r"(?i)\b(?:package|module|library|dependency|import|filename|file|path)\s*:?\s*$|[/\\]$"
PROTECTED = r"(?i)(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,31}(?::|\[:\])//[^\s<>\"']+|\S*@\S+"
CONFIDENCE = {"url": ("0.950", "0.900"), "ipv4": ("0.950", "0.820"), "ipv6": ("0.950", "0.820"), "domain": ("0.900", "0.780")}

#: How each hash algorithm is written beside a hash of its length.
LABELS = {"md5": r"(?i)\bmd5\b", "sha1": r"(?i)\bsha-?1\b", "sha256": r"(?i)\bsha-?256\b", "sha512": r"(?i)\bsha-?512\b"}

_MATCH = "array<struct<rank:int,kind:string,field:string,at:int,end:int,raw:string,before:string,near:string,context:string,shielded:boolean>>"


def _trimmed(kind: str, raw: str) -> str:
    """Closing punctuation is not part of a match; a bracket that closes an address is."""
    if kind != "url":
        return raw.rstrip(".,;!?)]}")
    raw = raw.rstrip(".,;!?)}")
    bare = raw.rstrip("]")
    return bare + "]" if bare != raw and re.search(r"//\[[0-9a-f:.]{0,45}\Z", bare) else bare


def _matcher():
    found = [(i, k, re.compile(TRIGGERS[k]), re.compile(p)) for i, (k, p) in enumerate(PATTERNS.items())]
    shield = re.compile(PROTECTED)

    @F.pandas_udf(_MATCH)
    def matches(title: pd.Series, summary: pd.Series) -> pd.Series:
        def one(t, s):
            out = []
            shields = {}
            for rank, kind, trigger, pattern in found:
                n = 0
                for field, text in (("title", t or ""), ("summary", s or "")):
                    if not trigger.search(text):
                        continue
                    for m in pattern.finditer(text):
                        if n == CAPS[kind] or len(out) == TOTAL:
                            break
                        n += 1
                        raw, at = _trimmed(kind, m[0]), m.start()
                        end = at + len(raw)
                        if field not in shields:
                            # without one of the two there is no shield, and looking for one takes long
                            shields[field] = [x.span() for x in shield.finditer(text)] if "@" in text or "//" in text else []
                        before, after = text[max(at - NEAR, 0) : at], text[end : end + NEAR]
                        out.append({"rank": rank, "kind": kind, "field": field, "at": at, "end": end, "raw": raw, "before": before, "near": f"{before} {after}", "context": " ".join((before + raw + after).split())[:SNIPPET], "shielded": any(a <= at and end <= b for a, b in shields[field])})
            return [x for x in out if x["raw"]]

        return pd.Series([one(t, s) for t, s in zip(title, summary)])

    return matches


def _with(df: DataFrame, **columns) -> DataFrame:
    """df with columns that later filters refer to as they are. Filters on plain projections are pushed below them,
    each time with a copy of the expression; copies within copies took seconds to plan."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def accepted(c: DataFrame) -> DataFrame:
    """Candidates(kind, value, form, before, near) with `accepted`, whether each counts as an indicator, and `labelled`, whether
    a hash stands beside the name of its algorithm: public addresses and hosts only, and unless it is defanged, a word nearby that says so."""
    is_ = lambda k: F.col("kind") == k
    url = is_("url")
    host = F.when(url, F.regexp_extract("value", r"^https?://(\[[^\]]*\]|[^/:?#]*)", 1)).otherwise(F.col("value"))
    c = _with(_with(c, host=F.regexp_replace(host, r"[\[\]]", "")), address=F.coalesce(O.ipv4("host"), O.ipv6("host")))
    literal = F.col("form") == "literal"
    sized = O.hash_algorithm("value")
    labelled = F.lit(False)
    for name, pattern in LABELS.items():
        labelled = labelled | ((sized == name) & F.col("near").rlike(pattern))
    public = F.col("address").isNull() | O.global_address("address")
    c = _with(c, labelled=labelled)
    ok = (
        F.when(url, ~F.col("host").rlike(RESERVED) & public)
        .when(is_("file_hash"), ~F.col("value").rlike(r"^(.)\1*$") & F.col("near").rlike(WORDS["file_hash"]))
        .when(is_("domain"), ~F.col("value").rlike(RESERVED) & ~F.col("value").rlike(FILES) & (~literal | (F.col("near").rlike(WORDS["domain"]) & (F.col("before").rlike(NAMED) | ~F.col("before").rlike(UNNAMED)))))
        .otherwise(public & (~literal | (F.col("near").rlike(WORDS["ipv4"]) & ~F.col("before").rlike(VERSION))))
    )
    return _with(c, accepted=ok).drop("host", "address")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as a shuffle has, by keys. Rows that are small but take long would else be read, and worked on,
    in the one or two tasks that their bytes are worth."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _host(c: str) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"^https?://(\[[^\]]*\]|[^/:?#]*)", 1), r"[\[\]]", "")


def excluded(exclusions: DataFrame, key: str) -> DataFrame:
    """(key, token) of exclusions(key, url, host): the normal forms of the urls, of their hosts, and of the hosts. What has no
    normal form excludes nothing."""
    named = exclusions.select(key, O.url("url").alias("u"), F.coalesce(O.domain("host"), O.ipv4("host"), O.ipv6("host")).alias("h"))
    whole = named.select(key, "u", "h", F.nullif(_host("u"), F.lit("")).alias("of_url"))
    return whole.select(key, F.explode(F.array_distinct(F.array_compact(F.array("u", "h", "of_url")))).alias("token")).distinct()


def extract(df: DataFrame, key: str = "id", title: str = "title", summary: str = "summary", exclusions: DataFrame | None = None) -> DataFrame:
    """(key, kind, value, algorithm, identity, form, confidence, field, at, context): the observables of each text, each
    once with its best evidence. Texts of more than LONGEST characters, or with control characters, give none.

    exclusions(key, url, host): what is no indicator of a text, such as its own page: these urls, all urls of these hosts and
    of the urls' hosts, and the hosts themselves, in normal form; other texts are not concerned."""
    matches = _matcher()
    t, s = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(summary), F.lit(""))
    texts = df.select(key, t.alias("title"), s.alias("summary")).where((F.length("title") + F.length("summary") <= LONGEST) & ~F.concat("title", "summary").rlike(r"[\x00-\x1F\x7F-\x9F]"))
    texts = spread(texts.withColumn("text", F.xxhash64("title", "summary")), key, "text")
    # what is near a match is cut out where it is found: candidates carry no texts. Texts that share a key stay apart
    c = texts.select(key, "text", F.explode(matches("title", "summary")).alias("m")).select(key, "text", "m.*")
    url = F.col("kind") == "url"
    c = _with(c, plain=O.refanged("raw"), form=F.when((F.col("kind") != "file_hash") & O.defanged("raw"), "defanged").otherwise("literal"))
    is_ = lambda k: F.col("kind") == k
    literal = F.col("form") == "literal"
    value = F.when(url, O.url("plain")).when(is_("ipv4"), O.ipv4("plain")).when(is_("ipv6"), O.ipv6("plain")).when(is_("file_hash"), O.file_hash("plain")).when(is_("domain"), O.domain("plain"))
    c = _with(c, value=value).where(F.col("value").isNotNull())
    c = accepted(c)
    if exclusions is not None:
        hers = excluded(spread(exclusions, key), key).withColumnRenamed(key, "_key")
        c = _with(c, host=F.when(url, _host("value")))
        c = c.join(hers, (F.col(key) == F.col("_key")) & ((F.col("value") == F.col("token")) | (F.col("host") == F.col("token"))), "left_anti").drop("host")
    c = c.where(F.col("accepted") & (url | ~F.col("shielded"))).select(key, "text", "rank", "kind", "field", "at", "end", "value", "form", "labelled", "context")
    # what lies within an accepted match of an earlier kind is part of it
    spans = F.collect_list(F.struct("rank", "field", "at", "end")).over(Window.partitionBy(key, "text"))
    c = c.withColumn("spans", spans).where(~F.exists("spans", lambda x: (x["rank"] < F.col("rank")) & (x["field"] == F.col("field")) & (F.col("at") >= x["at"]) & (F.col("end") <= x["end"])))
    conf = F.when(is_("file_hash"), F.when(F.col("labelled"), "0.900").otherwise("0.840"))
    for kind, (fanged, plain) in CONFIDENCE.items():
        conf = conf.when(is_(kind), F.when(literal, plain).otherwise(fanged))
    c = c.withColumn("confidence", conf.cast("decimal(4,3)")).withColumn("algorithm", F.when(is_("file_hash"), O.hash_algorithm("value")))
    c = c.withColumn("identity", O.identity("kind", "algorithm", "value"))
    best = c.groupBy(key, "text", "identity").agg(F.max_by(F.struct("kind", "value", "algorithm", "form", "confidence", "field", "at", "context"), F.struct("confidence", F.col("field") == "title", -F.col("rank"), -F.col("at"))).alias("b"))
    return best.select(key, "identity", "b.*")
