"""Shapes of physical plans: what is pushed down, bounded, or kept from becoming a nested loop."""

import contextlib
import io

import pytest

from sentrylake.operators.filters import in_year
from sentrylake.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.QUERIES[name](spark, FOLDER).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    if name != "l12_retention_plan":  # there a table of one row is added to a page
        assert "NestedLoopJoin" not in text


def test_ranges_reach_the_scan(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        spark.read.parquet(f"{FOLDER}/orders.parquet").where(in_year("o_orderdate", 1996)).select("o_orderkey").explain("formatted")
    assert "GreaterThanOrEqual(o_orderdate" in out.getvalue() and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in out.getvalue()


def test_columns_are_pruned(spark):
    text = plan(spark, "p01_pruned")
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


@pytest.mark.parametrize("name", ["l01_recently_ingested", "items_newest_page", "l09_fair_candidates"])
def test_pages_are_bounded(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["w01_alias_top20", "w02_nested_caps"])
def test_group_limits(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["j09_having_source", "j10_retryable", "j15_catalog_known"])
def test_semi_joins(spark, name):
    assert "LeftSemi" in plan(spark, name)


def test_dashboard_reads_once(spark):
    assert plan(spark, "a02_a05_dashboard").count("Scan parquet") == 2  # in the tree and in its details


def test_indicators_of_whole_texts(spark):
    """Addresses and hashes against a plain search; whatever is public comes out once for each text."""
    import ipaddress
    import re

    from sentrylake.plans import registry

    folder = "/root/testdata/sf0.01"
    got = {(r.id, r.kind, r.value) for r in registry.QUERIES["x233_ioc_extract"](spark, folder).collect()}
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        text = (r.text or "").replace("\n", " ").replace("\t", " ")
        text = re.sub(r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b", r"IP address \1", text).replace('token = "', 'hash "')
        title = text.split(". ", 1)[0]
        if len(title) + len(text) > 12_000 or re.search(r"[\x00-\x1f\x7f-\x9f]", text):
            continue
        for x in set(re.findall(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w.])", text)):
            try:
                if ipaddress.ip_address(x).is_global and not ipaddress.ip_address(x).is_multicast:
                    want.add((r.doc_id, "ipv4", x))
            except ValueError:
                pass
        want |= {(r.doc_id, "file_hash", x) for x in set(re.findall(r'(?<=hash ")[0-9a-f]{40}(?=")', text))}
    assert want and {g for g in got if g[1] in ("ipv4", "file_hash")} == want


def test_all_kinds_of_indicators_in_made_up_texts(spark):
    """Every token is planted with what decides on it, so what must come out is known for each text, near words and all."""
    import random

    from sentrylake.functions import ioc

    r = random.Random(4)
    # (text, expected kind and value or None)
    parts = [
        ("see https://a{n}.co/x?b=1 now", ("url", "https://a{n}.co/x?b=1")),
        ("see hxxps://a{n}[.]co/x]. now", ("url", "https://a{n}.co/x")),
        ("see https://www.example.org/{n} now", None),
        ("see http://10.0.0.{n}/ now", None),
        ("address 9.9.8.{n} here", ("ipv4", "9.9.8.{n}")),
        ("8[.]8[.]7[.]{n} here", ("ipv4", "8.8.7.{n}")),
        ("version 4.3.2.{n} here", None),
        ("plain 9.9.7.{n} here", None),
        ("IP 192.168.0.{n} here", None),
        ("host 2606:4700::{n} here", ("ipv6", "2606:4700::{n}")),
        ("host fe80::{n} here", None),
        ("md5 " + "ab12cd34" * 3 + "{n:08d} here", ("file_hash", "ab12cd34" * 3 + "{n:08d}")),
        ("token " + "ab12cd34" * 3 + "{n:08d} here", None),
        ("domain evil{n}.co here", ("domain", "evil{n}.co")),
        ("evil{n}[.]org here", ("domain", "evil{n}.org")),
        ("import evil{n}.co here", None),
        ("domain tool{n}.exe here", None),
        ("mail me@evil{n}.co here", None),
        ("domain host{n}.local here", None),
    ]
    filler = "w" * 130  # longer than what counts as near
    rows, want = [], set()
    for i in range(120):
        texts = {"title": [], "summary": []}
        for part, expected in r.sample(parts, 6):
            n = r.randint(11, 99)
            texts[r.choice(["title", "summary"])].append(f"{filler} {part.format(n=n)} {filler}")
            if expected:
                want.add((i, expected[0], expected[1].format(n=n)))
        rows.append((i, " ".join(texts["title"]), " ".join(texts["summary"])))
    rows.append((0, "domain other.co", "the same id with another text"))
    want.add((0, "domain", "other.co"))
    rows.append((500, "domain control.co", "a" + chr(7)))
    got = {(x.id, x.kind, x.value) for x in ioc.extract(spark.createDataFrame(rows, "id int, title string, summary string").repartition(3)).collect()}
    assert got == want
