import hashlib
import random
import re

import pytest

from sentrylake.llm import decontaminate as dc

from .helpers import text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, it in items:
            x = words(it)
            m = min(10, len(x))
            wins = {tuple(x[p : p + m]) for p in range(len(x) - m + 1)} if m else set()
            for p in range(len(w) - m + 1) if m else ():
                if tuple(w[p : p + m]) in wins:
                    hit |= set(range(p, p + m))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def cases():
    r = random.Random(4)
    items = [(i, text(r, n)) for i, n in enumerate([12, 30, 10, 9, 5, 1, 0, 40, 11])] + [(1, text(r, 15)), (50, None)]
    items = [(i, (t or "").replace("alpha", "ALPHA-x") if t is not None else None) for i, t in items]
    # single frequent words as items would hit everything: give the short ones rare words
    items[5] = (5, "zzyzx")
    items[4] = (4, "rare one two rare five")
    docs = []
    for d in range(40):
        parts = [text(r, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            x = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(x) - 10))
            parts += [" ".join(x[a : a + r.choice([8, 9, 10, 14])]), text(r, r.randint(0, 5))]
        docs.append((d, " , ".join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (0, docs[0][1]), (103, "zzyzx"), (104, text(r, 3000) + " " + items[1][1])]
    return docs, items


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_against_brute_force(spark, bytes_):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = sorted(str(tuple(r)) for r in dc.decontaminate(d, b, bytes_).collect())
    assert got == brute(docs, [x for x in items if x[1] is not None])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(d, none).collect()[0].contaminated is False
    assert dc.decontaminate(d.limit(0), none).count() == 0


def test_stage_keeps_clean_rows(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, "x " + item), (2, "clean"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.keep_uncontaminated(d, b).collect()) == [2, 3]
