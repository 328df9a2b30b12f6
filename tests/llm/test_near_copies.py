import random

import numpy as np
import pytest

from sentrylake.llm import near_copies as nc


def made(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def edited(r, words, least):
    """A copy with words replaced as long as the similarity of 5-word shingles stays at `least`."""
    now = list(words)
    while True:
        new = list(now)
        new[r.randrange(len(new))] = f"x{r.randrange(10**6)}"
        if not nc.similar(*(nc.shingles(nc.words_of(" ".join(x)), 5) for x in (words, new)), least):
            return now
        now = new


@pytest.mark.parametrize("cap", [256, 3])
def test_groups_by_exact_similarity(spark, cap):
    r = random.Random(4)
    docs, gone = [], set()
    for i in range(40):
        base = made(r, r.choice([60, 150, 400]))
        docs.append((10 * i, " ".join(base)))
        docs.append((10 * i + 1, " ".join(edited(r, base, 0.8))))
        gone.add(10 * i + 1)
        far = list(base)
        for j in range(0, len(far), 12):  # about 0.4
            far[j] = "far"
        docs.append((10 * i + 2, " ".join(far)))
    # a dense group
    base = made(r, 200)
    for i in range(30):
        docs.append((1000 + i, " ".join([*base[:100], f"n{i}", *base[100:]])))
        gone.add(1000 + i)
    gone.discard(1000)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    kept = {x.doc_id for x in nc.keep_one(df, list_cap=cap).collect()}
    assert kept == {d for d, _ in docs} - gone


def test_short_and_wordless(spark):
    docs = [(1, "a b"), (2, "A  b"), (3, "a c"), (4, None), (5, " \n"), (6, "")]
    assert sorted(x.doc_id for x in nc.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [1, 3, 4]


def test_group_below_the_similarity_makes_few_pairs(spark, monkeypatch):
    """Texts of one origin, 0.47 similar to each other: candidates do not grow with the square of the group."""
    r = random.Random(8)
    base, docs = made(r, 130), []
    for i in range(300):
        words = list(base)
        for j in r.sample(range(0, 130, 5), 5):
            words[j] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs.append((1000, docs[7][1] + " end"))
    rows, stored = {}, nc.stored

    def counted(df, tag):
        out = stored(df, tag)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(nc, "stored", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in nc.keep_one(df).collect()} == set(range(300))
    assert 1 <= rows["pairs"] < 300


def test_texts_without_shared_shingles_are_not_posted(spark, monkeypatch):
    r = random.Random(9)
    line = " ".join(made(r, 8))
    docs = [(i, " ".join([*made(r, 200), line])) for i in range(100)]
    docs += [(200, docs[5][1] + " end"), (201, "x " + docs[6][1])]
    posted, was = [], nc._posted
    monkeypatch.setattr(nc, "_posted", lambda texts: posted.append(texts.count()) or was(texts))
    assert {x.doc_id for x in nc.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == set(range(100))
    assert posted == [4, 4]


def test_bounds_keep_similar_texts():
    r = random.Random(10)
    for size in [1, 5, 6, 30, 101, 400, 3000]:
        for _ in range(20):
            both = [r.getrandbits(64) for _ in range(size)]
            most = int(len(both) / 0.8 + 1e-9) - len(both)
            mine = r.randrange(most + 1)
            a, b = (np.array(both + [r.getrandbits(64) for _ in range(n)], np.uint64) for n in (mine, most - mine))
            assert len(both) >= 0.8 * (size + most) - 1e-9
            heads = [set(nc.head(x, 0.8).tolist()) for x in (a, b)]
            assert len(heads[0] & heads[1]) >= max(1, int(max(len(a), len(b)) * nc.SHARED * 0.8))
            table = lambda x: (None, None, None, np.array([len(x)]), np.zeros((1, 2), np.uint64), nc.counters(x)[None, :])
            alone = tuple(None if x is None else x[0] for x in table(a))
            assert nc._close(table(a), table(b), 0.8).all() and nc._close(table(b), alone, 0.8).all()
