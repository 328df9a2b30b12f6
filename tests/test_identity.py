"""Joint identity against a plain loop over dictionaries of rows, and the cases that the rules turn on."""

import random

import pytest

from sentrylake.operators import components as C
from sentrylake.operators.identity import resolved_publications

ROWS = "place long, source string, external_id string, url_hash string, title_hash string, content_hash string, item_type string"
RECORDS = "id string, source string, external_id string, url_hash string, content_hash string, item string"
ITEMS = "id string, item_type string, status string"
NAMES = "namespace string, value string, item string"


def resolve(spark, rows, records=(), items=(), names=()):
    frames = [spark.createDataFrame(list(d), s).repartition(3) for d, s in ((rows, ROWS), (records, RECORDS), (items, ITEMS), (names, NAMES))]
    return {r.place: tuple(r)[1:] for r in resolved_publications(*frames).collect()}


def loop(rows, records, items, names):
    """By scans over lists of rows, as the rules are said."""
    records, items, names, out = [dict(zip("i s e u c t".split(), r)) for r in records], {i: (k, s) for i, k, s in items}, [list(n) for n in names], {}
    for place, s, e, u, t, c, kind in sorted(rows):
        if None in (s, e, u, t):
            out[place] = ("failed", "missing_key", None, None)
            continue
        ok = lambda i: items.get(i) == (kind, "active")
        a = next((r for r in records if r["s"] == s and r["e"] == e), None)
        b = next((r for r in records if r["s"] == s and r["u"] == u), None)
        nu = next((n[2] for n in names if n[:2] == ["url", u]), None)
        nt = next((n[2] for n in names if n[:2] == ["title", t]), None)
        if a is not None and b is not None and a is not b:
            out[place] = ("failed", "two_records", a["i"], a["t"])
            continue
        r = a or b
        item = r["t"] if r else nu
        several = item is not None and any(sum(n[0] == ns and n[2] == item for n in names) > 1 for ns in ("url", "title"))
        apart = any(n is not None and not ok(n) for n in (nu, nt)) or len({n for n in (nu, nt, item) if n is not None}) > 1
        if r is None:
            if apart or (nu is not None and several):
                out[place] = ("failed", "identity_conflict", None, None)
            elif nu is None and nt is not None:
                out[place] = ("failed", "title_only", None, None)
            else:
                new = f"new:{place}"
                if nu is None:
                    items[new] = (kind, "active")
                    names += [["url", u, new], ["title", t, new]]
                records.append({"i": new, "s": s, "e": e, "u": u, "c": c, "t": nu or new})
                out[place] = ("created" if nu is None else "linked", None, new, nu or new)
            continue
        if item is None or not ok(item):
            out[place] = ("failed", "inactive_item", r["i"], item)
        elif several or apart:
            out[place] = ("failed", "identity_conflict", r["i"], item)
        else:
            names = [n for n in names if n[2] != item] + [["url", u, item], ["title", t, item]]
            out[place] = ("unchanged" if r["c"] == c else "updated", None, r["i"], item)
            if r["c"] != c:
                r.update(e=e, u=u, c=c)
    return out


def test_a_link_gives_no_name(spark):
    items, names = [("A", "advisory", "active")], [("url", "u1", "A"), ("title", "t1", "A")]
    rows = [(1, "s", "e1", "u1", "t9", "c", "advisory"), (2, "s", "e2", "u2", "t9", "c", "advisory")]
    assert resolve(spark, rows, (), items, names) == {1: ("linked", None, "new:1", "A"), 2: ("created", None, "new:2", "new:2")}


def test_rules(spark):
    items = [("A", "advisory", "active"), ("B", "advisory", "archived"), ("C", "news", "active"), ("D", "advisory", "active")]
    names = [("url", "ua", "A"), ("title", "ta", "A"), ("url", "ub", "B"), ("url", "uc", "C"), ("title", "td", "D"), ("url", "ud", "D"), ("url", "ud2", "D")]
    records = [("r1", "s", "e1", "ua", "c1", "A"), ("r2", "s", "e2", "ub", "c2", "B"), ("r3", "s", "e3", "u3", "c3", None), ("r4", "s", "e4", "ud", "c4", "D")]
    row = lambda place, e, u, t, c="c", kind="advisory", s="s": (place, s, e, u, t, c, kind)
    rows = [
        row(1, "e1", "ua", "ta", "c1"),
        row(2, "e1", "ub", "ta"),
        row(3, "e2", "x2", "x2"),
        row(4, "e3", "x3", "x3"),
        row(5, "e5", "uc", "x5"),
        row(6, "e6", "x6", "ta"),
        row(7, "e4", "ud", "td"),
        row(8, "e1", "ua", "td"),
        row(9, "e1", "ua", "t9", "c9"),
        row(10, "e10", "x10", "ta"),  # A has given up ta
        row(11, "e1", "ua", "t11", "c9", s="other"),  # another source: no record of its own, linked by the url
        row(12, "e1", "u12", "t9", "c9", kind="news"),
        (13, "s", None, "u", "t", "c", "advisory"),
    ]
    got = resolve(spark, rows, records, items, names)
    assert got == loop(rows, records, items, names)
    assert [got[i][:2] for i in range(1, 14)] == [("unchanged", None), ("failed", "two_records"), ("failed", "inactive_item"), ("failed", "inactive_item"), ("failed", "identity_conflict"), ("failed", "title_only"), ("failed", "identity_conflict"), ("failed", "identity_conflict"), ("updated", None), ("created", None), ("linked", None), ("failed", "inactive_item"), ("failed", "missing_key")]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rows_equal_a_loop(spark, seed):
    pick = random.Random(seed)
    kinds, states = ["advisory", "advisory", "advisory", "news"], ["active", "active", "active", "archived"]
    items = [(f"i{k}", pick.choice(kinds), pick.choice(states)) for k in range(60)]
    names = [(ns, f"{ns[0]}{k}", f"i{pick.choice([k, k, k, k // 2])}") for k in range(60) for ns in ("url", "title") if pick.random() < 0.8]
    records = [(f"r{k}", f"s{k % 2}", f"e{k}", f"u{k}", "c0", pick.choice([f"i{k}", f"i{k}", None])) for k in range(0, 60, 2)]
    near = lambda p, k: f"{p}{k // 6 * 6 + pick.randrange(6)}"
    rows = [(i, f"s{pick.randrange(2)}", near("e", k), near("u", k), near("t", k), f"c{pick.randrange(3)}", pick.choice(kinds)) for i, k in ((i, pick.randrange(90)) for i in range(400))]
    got = resolve(spark, rows, records, items, names)
    assert got == loop(rows, records, items, names)
    assert {x[0] for x in got.values()} == {"created", "linked", "updated", "unchanged", "failed"}


def test_none(spark):
    assert resolve(spark, []) == {}


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components(spark, one_task):
    pick = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(pick.randrange(100, 300), pick.randrange(100, 300)) for _ in range(90)] + [(7, 7), (None, 3), (900, None)]
    root = {x: x for u, v in links if u is not None and v is not None and u != v for x in (u, v)}
    for _ in root:
        for u, v in links:
            if u in root and v in root:
                root[u] = root[v] = min(root[u], root[v])
    got = C.components(spark.createDataFrame(links, "a long, b long").repartition(5), one_task).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
