"""Batches whose rows see each other, and walks over pages."""

from sentrylake.operators import ordered as B
from sentrylake.operators import upserts as U
from sentrylake.sources import seed, walks


def test_a_refused_row_claims_nothing(spark):
    rows = [("b", 1, "A", "1", "x"), ("b", 2, "A", "2", "x"), ("b", 3, "B", "2", "y"), ("b", 4, "A", "1", "x"), ("b", 5, "A", "1", "z"), ("b", 6, "B", "2", "y"), ("c", 2, "A", "2", "x"), (None, 1, None, None, None)]
    df = spark.createDataFrame(rows, "batch string, at long, e string, u string, c string").repartition(4)
    got = {(r.batch, r.place): r.identity for r in B.accepted_in_order(df, "batch", "at", "e", "u", "c").collect()}
    assert got == {("b", 1): "accepted", ("b", 2): "conflict", ("b", 3): "accepted", ("b", 4): "duplicate", ("b", 5): "conflict", ("b", 6): "duplicate", ("c", 2): "accepted", (None, 1): "accepted"}
    assert B.accepted_in_order(df.limit(0), "batch", "at", "e", "u", "c").count() == 0


def test_upserts_of_one_batch(spark):
    current = spark.createDataFrame([(1, "e1", "u1", "c1"), (2, "e2", "u2", "c2")], "id long, external_id string, url_hash string, content_hash string")
    rows = [
        (1, "e1", "u1", "c1", "1", "unchanged"),
        (2, "e1", "u9", "c9", "1", "updated"),  # takes u9 and leaves u1
        (3, "e7", "u1", "c7", "new:1", "created"),  # so u1 is free
        (4, "e7", "u1", "c7", "new:1", "unchanged"),
        (5, "e8", "u1", "c8", "new:1", "updated"),  # takes e8 and leaves e7
        (6, "e7", "u7", "c", "new:2", "created"),
        (7, "e8", "u2", "c", "new:1", "failed"),  # two records
        (8, "e2", "u9", "c", "2", "failed"),
        (9, "e2", "u2", "c3", "2", "updated"),
    ]
    incoming = spark.createDataFrame([("b", *r[:4]) for r in rows] + [("other", 1, "e7", "u1", "c1")], "batch string, place long, external_id string, url_hash string, content_hash string").repartition(3)
    got = {(x.batch, x.place): (x.record, x.outcome) for x in B.publication_outcomes(current, incoming).collect()}
    assert got == {("b", r[0]): r[4:] for r in rows} | {("other", 1): ("1", "unchanged")}


def test_refused_transitions_change_nothing(spark):
    events = [(1, "success"), (2, "running"), (3, "running"), (4, "checkpoint_pending"), (5, "partial"), (6, "no_change"), (7, "failed"), (8, None)]
    df = spark.createDataFrame([("r", *e) for e in events], "run string, n long, status string")
    got = [(x.legal, x.state) for x in sorted(B.run_states(df, "run", "n", "status").collect(), key=lambda x: x.sequence)]
    assert got == [(False, None), (True, "running"), (False, "running"), (True, "checkpoint_pending"), (False, "checkpoint_pending"), (True, "no_change"), (False, "no_change"), (False, "no_change")]


def test_repeated_keys_are_inserted_once(spark):
    e = spark.createDataFrame([("a", 1)], "key string, fact int")
    i = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 3), ("b", 5, 4), ("b", 6, 5)], "key string, fact int, at int")
    assert {x["at"]: x.outcome for x in U.inserted(e, i, "key", ["fact"], "at").collect()} == {1: "reused", 2: "conflict", 3: "inserted", 4: "reused", 5: "conflict"}


def test_one_scheduled_cycle(spark):
    e = spark.createDataFrame([("k0", "scheduled", 3, "success")], "key string, trigger string, expected int, status string")
    i = spark.createDataFrame([(1, "k0", "scheduled", 3), (2, "k1", "scheduled", 3), (3, "k2", "scheduled", 3), (4, "k1", "scheduled", 3), (5, "m", "manual", 3), (6, "m", "manual", 4)], "at int, key string, trigger string, expected int")
    run = lambda known: {x["at"]: x.outcome for x in U.acquired_cycles(known, i, "key", ["trigger", "expected"], "at").collect()}
    assert run(e) == {1: "reused", 2: "acquired", 3: "overlap", 4: "reused", 5: "acquired", 6: "conflict"}
    busy = e.union(spark.createDataFrame([("k9", "scheduled", 3, "running")], e.schema))
    assert run(busy) == {1: "reused", 2: "overlap", 3: "overlap", 4: "overlap", 5: "acquired", 6: "conflict"}
    assert U.acquired_cycles(e, i.limit(0), "key", ["trigger", "expected"], "at").count() == 0


def test_walks_without_pages(spark):
    pages = spark.createDataFrame([], "w string, i long, token string, following string, more boolean")
    assert walks.token_walks(pages, ["w"], "i", "token", "following", "more", 5).count() == 0


def test_seed_set_holds(spark):
    sources, items = seed.dataset(spark)
    assert sources.count() == 4 and items.count() == 10 and seed.problems(sources, items).count() == 0
    assert {x.problem for x in seed.problems(sources.limit(0), items.union(items)).collect()} == {"undefined_source", "repeated_key"}
