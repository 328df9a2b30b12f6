"""Readers with bounds: JSON in one pass, elements by a stack, data blocks at any depth, feed files."""

import json
import random

import pytest

from sentrylake.functions import bounded_json as J
from sentrylake.sources import elements as E
from sentrylake.sources import feed_files as R


def strict(text):
    """By the library's parser, with no bounds."""
    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise KeyError
        return dict(items)

    def constant(x):
        raise OverflowError

    try:
        json.loads(text.removeprefix("﻿"), object_pairs_hook=pairs, parse_constant=constant)
    except KeyError:
        return "duplicate_key"
    except OverflowError:
        return "constant"
    except ValueError:
        return "malformed"
    return "ok"


@pytest.mark.parametrize("text", ['{}', '[]', ' [1, -0.5e3, true, null, "a\\u00e9\\n"] ', '{"a": {"a": []}, "b": [{}]}', '﻿{"a":1}', '"x"', '12', '[NaN]', '{"a":1,"a":2}', '{"a":1,"\\u0061":2}', '[1,]', '{"a":1,}', '{,}', '[01]', '[1 2]', '{"a" 1}', '{1:2}', '["\t"]', '["\\x"]', '', ' ', '[', ']', '{"a":[}', '[1]]', '[1] x', 'nul', '[+1]', '[.5]', '[1.]', "['a']", '[-]', '[truex]', '[-Infinity]'])
def test_state_is_that_of_a_strict_parser(text):
    assert J.state(text) == strict(text)


def test_random_texts():
    pick = random.Random(1)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', "1", "-2.5", "true", "null", " ", '"c":', "{}", "[1]"]
    for _ in range(20_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(9)))
        assert (J.state(text) == "ok") == (strict(text) == "ok"), text


def test_bounds():
    b = J.Bounds(size=200, depth=2, nodes=6, string=5)
    for text, want in (("[[[1]]]", "depth"), ("[[1]]", "ok"), ("[[[]]]", "ok"), ("[[[[]]]]", "depth"), ("[1,2,3,4,5]", "ok"), ("[1,2,3,4,5,6]", "nodes"), ('["12345"]', "ok"), ('["123456"]', "string"), ('["\\u0031\\u0032\\u0033\\u0034\\u0035"]', "ok"), ('{"123456":1}', "string"), ('"' + "é" * 120 + '"', "size"), ("[1e999]", "constant"), (None, "malformed")):
        assert J.state(text, b) == want, text
    assert J.state("[" * 1_000_000) == "depth"


def test_elements_of_a_stack():
    page = '<div class="a b"><p>One <b>two</b><br>three<script>x < y</script></div><P CLASS=c>four<div>five</p></div></span>end'
    out = {e["node"]: e for e in E.read_elements(page, frozenset(["div", "p", "b", "script", "br"]))}
    assert [(e["tag"], e["last"], e["text"]) for e in out.values()] == [("div", 4, "One twothree"), ("p", 4, "One twothree"), ("b", 2, "two"), ("br", 3, ""), ("script", 4, "x < y"), ("p", 6, "fourfive"), ("div", 6, "five")]
    assert out[0]["classes"] == ["a", "b"] and out[5]["attributes"] == {"class": "c"}
    assert E.read_elements("<b>" * 600, frozenset(["b"])) is None and E.read_elements("<br>" * 51_000, frozenset(["br"])) is None and E.read_elements(None, frozenset()) == []


CARD = '<article class="{c}"><h2 class="entry-title"><a href="{h}">{t}</a></h2>{more}</article>'


def card(h, t, more="", c="post type-post category-news"):
    return CARD.format(h=h, t=t, more=more, c=c)


def test_nested_containers(spark):
    page = card("/n/outer", "Outer", card("/n/inner", "In &amp; ner")) + card("/n/INNER", "Again") + card("http://else", "Else") + card("/n/x", "Other", c="post") + card("/n/t", "")
    df = spark.createDataFrame([(1, page), (2, "<i>" * 700), (3, None), (4, card("/a", "A")), (4, card("/a", "A"))], "page_id int, html string")
    out = E.listing(df, "article", ["post", "type-post", "category-news"], "h2", ["entry-title"]).collect()
    by = lambda i: [(r.place, r.title, r.link, r.outcome) for r in out if r.page_id == i]
    assert by(1) == [(0, None, None, "structure"), (1, "In & ner", "/n/inner", "accepted"), (2, "Again", "/n/INNER", "duplicate"), (3, "Else", "http://else", "invalid_url"), (4, "", "/n/t", "invalid_title")]
    assert by(2) == [(0, None, None, "unsafe")] and by(3) == [] and by(4) == [(0, "A", "/a", "accepted")] * 2
    assert [r.outcome for r in E.listing(df.where("page_id = 1"), "article", ["post"], "h2", [], most=2).collect()][2:] == ["record_limit"] * 4


def test_data_blocks():
    url = "https://x/1"
    art = {"@type": "NewsArticle", "headline": " The  head ", "datePublished": "2024-01-01"}
    dump = json.dumps
    assert E.publication_data([dump({"@graph": [{"@type": "WebSite"}, {"deep": [art]}]})], url)["headline"] == "The head"
    two = [dump([art | {"url": "https://x/2"}]), dump(art | {"headline": "Mine", "mainEntityOfPage": {"@id": url}, "@type": ["Thing", "Article"]})]
    assert E.publication_data(two, url)["headline"] == "Mine"
    assert E.publication_data([dump([art, art])], url) == {"problem": "ambiguous"}
    assert E.publication_data([dump(art | {"url": "https://x/2"})], url) == {"problem": "ambiguous"}
    assert E.publication_data(['{"a":1,"a":2}'], url) == E.publication_data(["[[[[[[[[[[1]]]]]]]]]]"], url) == E.publication_data(["{}"] * 11, url) == {"problem": "unsafe"}
    assert E.publication_data([], url) == E.publication_data(["{}"], url) == {}


def test_metadata_precedence(spark):
    data = '<script type="application/ld+json; charset=utf-8">{"@graph":[{"@type":"Article","headline":"From data"}]}</script>'
    meta = '<meta content="From graph" property="og:title"><meta content="2024-01-03" property="article:published_time"><meta name=Description content="About">'
    rows = [(1, "u", f"<title>Plain</title>{meta}{data}"), (2, "u", f"<title>Plain</title>{meta}"), (3, None, "<title> Pl&amp;ain </title>"), (4, "u", data.replace("}]", "]") + "<title>T</title>"), (5, "u", None)]
    got = [tuple(r) for r in E.page_metadata(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id").collect()]
    assert got == [(1, "From data", "About", "2024-01-03", None, None), (2, "From graph", "About", "2024-01-03", None, None), (3, "Pl&ain", None, None, None, None), (4, None, None, None, None, "unsafe"), (5, None, None, None, None, None)]


RSS = b'<?xml version="1.0"?><rss><channel><title>F</title><item><title>A &amp; b</title><link>http://x/1</link><guid>g1</guid><pubDate>Mon</pubDate><media><title>no</title></media></item><item><title>C</title></item></channel></rss>'
ATOM = b'<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>A</title><link rel="self" href="http://no"/><link href="http://x/2"/><id>i1</id><summary>s</summary><updated>u</updated><author><name>N</name></author></entry></feed>'


def test_entries_of_feeds():
    got, problem = R.pulled(RSS)
    assert problem is None and got == [{"title": "A & b", "link": "http://x/1", "guid": "g1", "published": "Mon", "kind": "rss"}, {"title": "C", "kind": "rss"}]
    assert R.pulled(ATOM) == ([{"title": "A", "link": "http://x/2", "guid": "i1", "description": "s", "updated": "u", "author": "N", "kind": "atom"}], None)
    assert [e["title"] for e in R.pulled(RSS[:-16])[0]] == ["A & b", "C"] and R.pulled(RSS[:90]) == ([], "malformed") and R.pulled(b"") == ([], "malformed")
    assert R.pulled(b"<!DOCTYPE a [<!ENTITY x 'y'>]>" + RSS[21:]) == ([], "doctype")
    assert R.pulled(RSS, nodes=5) == ([], "nodes") and R.pulled(RSS, depth=3) == ([], "depth") and R.pulled(RSS, entries=1) == ([], "entries")


def test_feed_files(spark, tmp_path):
    for name, data in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", b"nothing"), ("d.xml", RSS + b" " * 5000)):
        (tmp_path / name).write_bytes(data)
    out = R.feed_entries(spark, str(tmp_path), most_bytes=4000).collect()
    assert sorted((r.path[-5:], -1 if r.place is None else r.place, r.problem, r.kind) for r in out) == [("a.xml", 0, None, "rss"), ("a.xml", 1, None, "rss"), ("b.xml", 0, None, "atom"), ("c.xml", -1, "malformed", None), ("d.xml", -1, "size", None)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_batches_are_filled_in_order(spark, parts):
    from sentrylake.sources.feeds import score_batches

    pick = random.Random(parts)
    asked = [(f"cve-2024-{pick.randrange(10 ** pick.choice([4, 5, 9, 19])):04d}", pick.choice([None, *range(400)])) for _ in range(900)] + [("bad", 1), (None, 2)]
    first = {}
    for key, place in asked:
        if key and key != "bad":
            first[key.upper()] = min(first.get(key.upper(), (True, 0)), (place is None, place or 0))
    batches, size = [], 0
    for key in sorted(first, key=lambda k: (first[k], len(k), k)):
        if not batches or len(batches[-1]) >= 12 or size + len(key) + 1 > 200:
            batches.append([])
            size = -1
        batches[-1].append(key)
        size += len(key) + 1
    got = score_batches(spark.createDataFrame(asked, "k string, p long"), "k", 12, 200, "p", parts).orderBy("batch").collect()
    assert [list(r["keys"]) for r in got] == batches and [r.batch for r in got] == list(range(len(batches)))
