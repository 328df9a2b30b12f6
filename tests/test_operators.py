import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.operators import filters as C
from sentrylake.operators import joins as J
from sentrylake.operators import paging as L
from sentrylake.operators import ranking as W
from sentrylake.operators import sets as X
from sentrylake.operators import upserts as U


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_orders_with_nulls_and_ties(spark):
    rows = [(1, "2024-01-02"), (2, None), (3, "2024-01-02"), (4, None), (5, "2024-01-01"), (6, "2024-01-02")]
    df = spark.createDataFrame(rows, "id int, published string").withColumn("created", F.lit(1))
    assert ids(L.page(df, L.orders("newest_published"), 10)) == [6, 3, 1, 5, 4, 2]
    assert ids(L.page(df, L.orders("oldest_published"), 10)) == [5, 1, 3, 6, 2, 4]
    assert ids(L.page(df, L.orders("recently_ingested"), 2, 1)) == [5, 4]
    for limit, offset in ((0, 0), (101, 0), (1, -1), (1, 10_001)):
        with pytest.raises(ValueError):
            L.page(df, L.orders("newest_published"), limit, offset)


def test_wildcards_are_literal(spark):
    titles = ["100% sure", "100 sure", "a_b", "axb", "back\\slash", "MiXeD"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    found = lambda s: [r.t for r in df.where(C.contains_any(s, "t")).collect()]
    assert found("100%") == ["100% sure"] and found("A_B") == ["a_b"] and found("k\\s") == ["back\\slash"] and found("mixed") == ["MiXeD"]


def test_keyset_wraps_and_resets(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    assert ids(L.keyset(df, "id", 5, 4)) == [6, 7, 1, 2]
    assert L.next_cursor(L.keyset(df, "id", 5, 4), "id").first().cursor == 0
    assert L.next_cursor(L.keyset(df, "id", 2, 3), "id").first().cursor == 5


def test_neighbours_of_a_small_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, 9), (9, 4), (0, 1)], "source long, target long")
    got = sorted(map(tuple, J.neighbours(nodes, edges).collect()))
    assert got == sorted([(0, 1, "outgoing"), (0, 1, "outgoing"), (1, 0, "incoming"), (1, 0, "incoming"), (1, 0, "outgoing"), (0, 1, "incoming"), (2, 2, "outgoing"), (3, 9, "outgoing"), (4, 9, "incoming")])


def test_semi_join_adds_no_rows(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert ids(J.having(a, "id", b, "k")) == [1] and ids(J.lacking(a, "id", b, "k")) == [2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_picks_do_not_depend_on_the_order_of_rows(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 3), i, r.random() < 0.3, r.choice([None, "a", "b"]), r.choice([None, "x"]), "u", r.randint(0, 2)) for i in range(20)]
    schema = "item_id int, record_id int, is_primary boolean, source string, external_id string, url string, seen int"
    want = {}
    for row in rows:
        key = (not row[2], row[3] or "", row[4] or "", row[5], row[6], row[1])
        want[row[0]] = min(want.get(row[0], (key, row[1])), (key, row[1]))
    r.shuffle(rows)
    got = {x.item_id: x.record_id for x in J.primary_record(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert got == {k: v[1] for k, v in want.items()}


def test_version_lineage(spark):
    rows = [("a", 1, "m", 0, "c", False, "p1"), ("a", 2, "m", 0, "c", True, "p2"), ("b", 1, "m", 0, "c", True, "p"), ("b", 2, "m", 0, "c", False, "q"), ("c", 1, "m", 0, "c", False, "x"), ("c", 1, "m", 0, "c", False, "y")]
    df = spark.createDataFrame(rows, "id string, modified int, type string, created int, creator string, revoked boolean, payload string")
    got = {r.id: (r.modified, r.lineage_holds) for r in W.latest_versions(df).collect()}
    assert got == {"a": (2, True), "b": (2, False), "c": (1, False)}


def test_conflicts_reject_all_members(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, c string")
    assert sorted(ids(X.without_conflicts(df, ["k"], "c"), "k")) == [1, 1]
    assert {r.k: r.conflict for r in X.first_or_conflict(df.withColumn("o", F.monotonically_increasing_id()), ["k"], "c", "o").collect()} == {1: False, 2: True}


def test_merge_outcomes(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1), (4, "d", 9)], "id int, v string, seen int")
    inc = spark.createDataFrame([(2, "B", 2), (3, None, 2), (4, "D", 2), (5, "e", 2)], "id int, v string, seen int")
    newer = F.col("inc.seen") >= F.col("cur.seen")
    got = {r.id: (r.v, r.seen, r.outcome) for r in U.merged(cur, inc, ["id"], ["v"], "seen", newer).collect()}
    assert got == {1: ("a", 1, "absent"), 2: ("B", 2, "updated"), 3: (None, 2, "unchanged"), 4: ("d", 9, "stale"), 5: ("e", 2, "created")}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id int, v string, seen int")
    assert U.merged(none, none, ["id"], ["v"], "seen").count() == 0
    assert W.first_in_group(none, ["v"], ["id"], 3).count() == 0
    assert L.keyset(none, "id", 0, 5).count() == 0


def test_versioned_state(spark, tmp_path):
    from sentrylake.sources import sinks

    root = f"{tmp_path}/state"
    sinks.write_state(spark.createDataFrame([(1, "a")], "id int, v string"), root, 9)
    sinks.write_state(spark.createDataFrame([(1, "b"), (2, None)], "id int, v string"), root, 10)
    assert sorted(map(tuple, sinks.read_state(spark, root).collect())) == [(1, "b"), (2, None)]
    with pytest.raises(sinks.VersionTaken):
        sinks.write_state(spark.createDataFrame([(3, "c")], "id int, v string"), root, 10)


def test_shared_feed_by_author(spark):
    from sentrylake.sources import feeds

    rows = [(1, "x", "plain"), (2, "y", "a &amp;lt;b&amp;gt;"), (3, "z", "plain"), (4, None, "plain"), (5, "y", None)]
    got = feeds.by_author(spark.createDataFrame(rows, "id int, author string, title string"), "author", {"x": "one", "y": "two"}, ["title"])
    assert sorted((r.id, r.vendor) for r in got.collect()) == [(1, "one"), (5, "two")]
