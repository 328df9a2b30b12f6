import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sentrylake.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéß ", k=r.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(r.choices(words, k=40)) for _ in range(4)]
    texts = []
    for _ in range(n):
        body = [" ".join(r.choices(words, k=r.randint(1, 60)))]
        if r.random() < 0.5:
            body += [r.choice(passages)] * r.randint(1, 2) + [" ".join(r.choices(words, k=20))]
        texts.append(" ".join(body))
    texts += texts[:5] + [None, "", "a" * 900, "ab" * 500, "x"]
    near = texts[1] + " " + passages[0]
    texts += [near[:i] + "Z" + near[i + 1 :] for i in range(3, len(near), 37)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_order_is_that_of_sorted_suffixes(seed):
    r = random.Random(seed)
    texts = [bytes(r.choices(b"ab\0c", k=r.randint(1, 60))) for _ in range(20)]
    starts = [r.randint(0, len(t)) for t in texts]
    for depth in (3, 80):
        got = [texts[t][p : p + depth] for t, p in sd.two_stage_order(texts, starts, depth)]
        assert got == sorted(t[p : p + depth] for t, k in zip(texts, starts) for p in range(k))


@pytest.mark.parametrize("cap", [4096, 3])
def test_against_brute_force(spark, cap):
    texts = corpus(7)
    rows = [(i % 50, t, f"s{i % 3}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5)
    out = sd.remove_repeats(docs, length=60, gram=16, key_cap=cap).select("row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    got = Counter((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == Counter((i % 50, t, *b) for (i, t), b in zip(enumerate(texts), brute(texts, 60)))


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(sd, "_SEGMENT", 500)
    r = random.Random(3)
    base = "".join(r.choices("abcdefgh ", k=3000))
    texts = [base + "".join(r.choices("abcdefgh ", k=900)) + base[700:1500], base[2000:2400], "short"]
    out = {r.text: tuple(r)[1:] for r in sd.remove_repeats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), length=100, gram=16).selectExpr("row.text", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [out[t] for t in texts] == brute(texts, 100)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(docs).count() == 0


def test_common_prefixes():
    r = random.Random(8)
    whole = bytes(r.choices(b"ab", k=400))
    a, b = (np.array([r.randrange(300) for _ in range(200)]) for _ in range(2))
    want = [next((k for k in range(40) if whole[x + k] != whole[y + k]), 40) for x, y in zip(a.tolist(), b.tolist())]
    assert sd.common_prefixes(whole, a, b, 40).tolist() == want


@pytest.mark.parametrize("n", [150, 600])
def test_a_passage_of_many_documents_stays_counts(spark, monkeypatch, n):
    """However many documents share a passage, no key has more than a bounded number of bodies, and no sort more than the cap."""
    r = random.Random(6)
    passage = "".join(r.choices("abcdefgh ", k=150))
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(80, 160))) + passage + "".join(r.choices("abcdefgh ", k=100)) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    most = spark.sparkContext.accumulator(0)
    real = sd._sorted_marks

    def counting(*args):
        run = real(*args)

        def counted(batches):
            keys = Counter()

            def seen():
                for b in batches:
                    keys.update(b.column("key").to_pylist())
                    yield b

            yield from run(seen())
            if keys:
                most.add(max(keys.values()))

        return counted

    monkeypatch.setattr(sd, "_sorted_marks", counting)
    out = sd.remove_repeats(docs, length=60, gram=16, key_cap=40).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute(texts, 60)
    assert all(tuple(x)[1:] == want[x.doc_id] for x in out) and len(out) == n
    assert most.value <= 40 * 8  # a sum over the tasks of each one's largest key
