import random

import pytest
import xxhash

from sentrylake.llm import simhash_dedup as sh
from sentrylake.llm._components import connected_components

from .helpers import text


def slow_fingerprint(t):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    s = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(fps):
        ids.setdefault(find(i), []).append(d)
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(fps))]


def test_fingerprint():
    r = random.Random(1)
    for t in [None, "", " \t\n", "One", "one two THREE", "a\x1cb c\xa0d", *(text(r, n) for n in (4, 5, 30))]:
        assert sh.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("cap", [2048, 2])
def test_components_against_brute_force(spark, cap):
    r = random.Random(5)
    rows = []
    for i in range(60):
        base = text(r, 120).split()
        for _ in range(r.choice([1, 1, 2, 4])):
            copy = list(base)
            if r.random() < 0.8:
                copy[r.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
    rows += rows[:5] + [None, "", "x y"]
    r.shuffle(rows)
    docs = [(None if i == 3 else i, t, 1) for i, t in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp int").repartition(4)
    got = {(x.doc_id, x.fingerprint, x.component_id) for x in sh.near_duplicates(df, list_cap=cap).collect()}
    fps = [(d, slow_fingerprint(t)) for d, t, _ in docs]
    assert got == {(d, f"{f:016x}", c) for (d, f), c in zip(fps, brute(fps))}


@pytest.mark.parametrize("cap", [10_000, 4])
def test_links_of_random_neighbours(spark, cap):
    """A dense ball: every member differs from the centre in up to four bits."""
    r = random.Random(2)
    fps = set()
    for centre in (0x0123456789ABCDEF, 0xFFFF00000000FFFF):
        for _ in range(40):
            f = centre
            for b in r.sample(range(64), r.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    comp = {x.node: x.root for x in connected_components(sh.links(spark.createDataFrame(signed, "fp long"), cap)).collect()}
    groups = {}
    for (s,) in signed:
        groups.setdefault(comp.get(s, s), set()).add(s)
    want = brute([(s, s & (2**64 - 1)) for (s,) in signed])
    wanted = {}
    for (s,), c in zip(signed, want):
        wanted.setdefault(c, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "u long, v long").repartition(7)
    for one_task in (1 << 20, 0):
        got = {r.node: r.root for r in connected_components(links, one_task=one_task).collect()}
        assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_keep_one_and_empty(spark):
    t = text(random.Random(3), 80)
    docs = spark.createDataFrame([(7, t, "a"), (3, t, "b"), (9, "other words here now", "c")], "doc_id long, text string, component_id string")
    assert sorted(r.doc_id for r in sh.keep_one(docs).collect()) == [3, 9]
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
