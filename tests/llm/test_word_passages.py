import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentrylake.llm import suffix_dedup as sd


def words(r, n, size=5):
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(n)]


def test_passages_of_51_words(spark, tmp_path):
    """51 words of 5 letters are 305 bytes, of one letter 101; 50 words stay, whatever they have; strings of 400 bytes
    go without any space in them."""
    r = random.Random(9)
    passages = {"51": words(r, 51), "short": words(r, 51, 1), "50": words(r, 50, 6), "string": words(r, 1, 420)}
    docs, left = [], {}
    for i, (name, p) in enumerate(passages.items()):
        for j in range(2):
            before, after = words(r, 70), words(r, 70)
            docs.append((10 * i + j, " ".join([*before, *p, *after])))
            gone = name != "50"
            left[10 * i + j] = "".join([*before, *(() if gone else p), *after])
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long").repartition(3)
    out = corpus_pipeline.suffix_array_dedup(spark, df, str(tmp_path)).collect()
    assert {x.doc_id: "".join(x.text.split()) for x in out} == left and all(x.n_chars == len(x.text) for x in out)


@pytest.mark.parametrize("cap", [4096, 3])
def test_words_against_brute_force(spark, cap):
    r = random.Random(5)
    vocabulary = words(r, 200) + ["é", "東京", "a"]
    passages = [r.choices(vocabulary, k=n) for n in (5, 7, 8, 12, 30)]
    texts = []
    for _ in range(60):
        body = r.choices(vocabulary, k=r.randint(1, 30)) + r.choice(passages) + r.choices(vocabulary, k=r.randint(0, 9))
        texts.append(r.choice([" ", "  ", "\n"]).join(body))
    n = 8
    seen = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    want = {}
    for k, t in enumerate(texts):
        w = t.split()
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        want[k] = [x for j, x in enumerate(w) if j not in gone]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = sd.without_repeats(df, length=10_000, gram=16, key_cap=cap, words=n)
    assert {x.doc_id: x.text.split() for x in out.select("doc_id", F.col("text")).collect()} == want


def test_passages_are_counted_without_being_removed(spark):
    r = random.Random(11)
    shared = words(r, 60)
    rows = [(i, " ".join([*words(r, 40), *(shared if i < 2 else words(r, 60)), *words(r, 30)])) for i in range(4)]
    df = spark.createDataFrame([*rows, (9, None)], "doc_id long, text string")
    out = {x.doc_id: tuple(x)[1:] for x in sd.remove_repeats(df, words=51, by_words=False).selectExpr("row.doc_id", "n_removed", "n_spans", "n_passage_words").collect()}
    assert out == {0: (0, 0, 60), 1: (0, 0, 60), 2: (0, 0, 0), 3: (0, 0, 0), 9: (0, 0, 0)}
