import random
import re
import zlib
from collections import Counter

from sentrylake.llm import queries, spelling


def brute(docs, least=7, every=31, times=10):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    # every word with one letter taken out at each place: near words share one of these, or one is the other's
    near = {w: set() for w in n}
    masks = {}
    for w in n:
        for i in range(len(w)):
            masks.setdefault((len(w), i, w[:i] + w[i + 1 :]), []).append(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= set(group) - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f is not None and n[f] >= times * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


SF = "/root/testdata/sf0.01"


def test_table_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(queries.op11_spelling_variants(spark, SF))
    assert got == brute(docs)
    assert sum(r[1] is not None for r in got) > 50 and sum(r[4] for r in got) > 100


def test_dense_words_equal_brute_force(spark):
    """Few letters and few lengths: many near pairs, repeated bigrams, edits at every place, chains of forms."""
    pick = random.Random(5)
    words = ["".join(pick.choice("abé") for _ in range(pick.choice((7, 7, 8, 8, 9)))) for _ in range(500)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa", "×÷×÷×÷×", "Ééaaaaa"]
    text = [f"{w} " * pick.choice((1, 2, 3, 30, 400, 5000)) for w in words]
    docs = [(i, t) for i, t in enumerate(text)]
    got = rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), every=31))
    assert got == brute(docs)
    assert any(r[1] is not None and r[2] != r[1] for r in got)


def test_posts_of_near_words_meet():
    pick = random.Random(6)
    letters = "abcdeé"
    for _ in range(3000):
        a = "".join(pick.choice(letters) for _ in range(pick.randint(4, 12)))
        i = pick.randrange(len(a) + 1)
        b = pick.choice((a[:i] + pick.choice(letters) + a[i:], a[:i] + pick.choice(letters) + a[i + 1 :]))
        grams = list({x[k : k + 2] for x in (a, b) for k in range(len(x) - 1)})
        pick.shuffle(grams)
        rank = {g: k for k, g in enumerate(grams)}
        short, long = sorted((a, b), key=len)
        role = len(long) - len(short)
        assert a == b or {k for k, r in spelling.posts_of(short, rank) if r == 0} & {k for k, r in spelling.posts_of(long, rank) if r == role}


def test_odd_rows(spark):
    docs = [(None, "Wonderful wonderful"), (1, None), (2, ""), (3, "wonderfull wonderfull"), (3, "wonderfull wonderfull"), (4, "x" * 2_000 + " " + "x" * 2_000), (5, "wonderéful")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' as word", "1 as n", "'b' as form")
    got = rows(spelling.variants(df))
    assert got == brute([d for d in docs], every=None)
    assert [(r[0], r[3], r[4]) for r in got if len(r[0]) < 99] == [("wonderful", 2, 1), ("wonderfull", 4, 1)]
    assert rows(spelling.variants(df.limit(0))) == []


def test_very_long_words(spark):
    long = "".join(random.Random(7).choice("abcd") for _ in range(300_000))
    df = spark.createDataFrame([(1, f"{long} {long} {long[1:]} {long[1:]}")], "doc_id long, text string")
    assert sorted((len(r[0]), r[4]) for r in rows(spelling.variants(df))) == [(299_999, 1), (300_000, 1)]
