import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import _labels
from sentrylake.llm import quality_cnn as qc
from sentrylake.llm import toxicity as tx

from .helpers import text

BAD = ["scoundrel", "nitwit", "dolt"]


def labelled(n=700):
    r = random.Random(3)
    rows = []
    for i in range(n):
        toxic, junk = r.random() < 0.3, r.random() < 0.3
        words = text(r, r.randint(20, 120)).split()
        if toxic:
            for _ in range(1 + len(words) // 25):
                words[r.randrange(len(words))] = r.choice(BAD)
        if r.random() < 0.3:
            words[r.randrange(len(words))] = r.choice(["women", "muslims", "gay", "black"]) if toxic else "men"
        t = " ".join(words)
        rows.append((i, t.upper().replace(" ", "!! ") if junk else t, int(toxic), int(not junk)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, *_ in rows] + [(9000, None, 0.0), (9001, "", 0.0), (None, "no id", 0.0), (0, rows[0][1], 0.0)], "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([(i, q, t) for i, _, t, q in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_held_out_accuracy(spark, which):
    rows = labelled()
    docs, labels = frames(spark, rows)
    run, folds, out_fold, limit = (tx.classify, 5, 0, 0.5) if which == "toxic" else (qc.classify, 4, 2, 0.7)
    out = run(docs, labels).collect()
    assert len(out) == len(rows) + 4
    truth = {i: (t if which == "toxic" else q) for i, _, t, q in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % folds == out_fold}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in out)
    assert all(not r.held_out for r in out if r.doc_id is None)


@pytest.mark.parametrize("run", [tx.classify, qc.classify])
def test_without_labels(spark, run):
    docs, labels = frames(spark, labelled(12))
    assert len({r.score for r in run(docs, labels.limit(0)).collect()}) == 1
    assert run(docs.limit(0), labels.limit(0)).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = labelled()
    docs, labels = frames(spark, rows)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((str(r.doc_id), r.score) for r in df.collect())
    assert key(tx.classify(docs, labels)) == key(tx.classify(docs, flipped))


def test_counterfactuals_are_of_sentences():
    pairs = tx.counterfactuals(["No group here. Some Women sing! Men\nand boys", "nothing"])
    assert [a.strip() for a, _ in pairs] == ["Some Women sing!", "Men", "and boys"]
    assert all(a != b and a.split()[:-1] == b.split()[:-1] or "sing" in a for a, b in pairs)
    assert pairs == tx.counterfactuals(["No group here. Some Women sing! Men\nand boys"])
    assert tx.counterfactuals(["Die Winzer und die Fischer."], [["winzer", "fischer"]]) == [("Die Winzer und die Fischer.", "Die fischer und die winzer.")]
    assert tx.counterfactuals(["men"], []) == [] == tx.counterfactuals([])
    assert len(tx.counterfactuals([t for _, t, *_ in labelled()])) > 100  # what the penalty sees in these tests


def test_swaps_do_not_change_scores():
    """Groups that only toxic texts mention here must not make a neutral mention toxic."""
    rows = [(t, y) for _, t, y, _ in labelled()]
    plain, bias0 = tx.train(rows, swap_penalty=0.0)
    fair, bias1 = tx.train(rows, swap_penalty=20.0)
    neutral = ["alpha beta women gamma delta", "the muslims of omega and sigma", "a black kappa on zeta"]
    gap = lambda w, b: np.abs(tx.probabilities(pa.array(neutral), w, b) - tx.probabilities(pa.array([b for _, b in tx.counterfactuals(neutral)]), w, b)).max()
    assert gap(fair, bias1) < gap(plain, bias0) / 2 or gap(plain, bias0) < 0.02
    assert (tx.probabilities(pa.array(neutral), fair, bias1) < 0.5).all()


def test_whole_texts_are_read():
    rows = [(t, q) for _, t, _, q in labelled()]
    net, _ = qc.train(rows)
    good = text(random.Random(1), 60_000)
    late = good + " " + text(random.Random(2), 300).upper().replace(" ", "!! ")
    a, b = qc.probabilities(pa.array([good, late]), net)
    assert a >= 0.7 > b
    whole = qc.probabilities(pa.array([late]), net, segment=1 << 24)
    assert abs(whole[0] - b) < 0.05


def test_gradients():
    net = qc.Net(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = np.frombuffer((text(random.Random(1), 150) + text(random.Random(2), 40)).encode(), np.uint8)
    offsets = np.array([0, 700, len(data)])
    y = np.array([1.0, 0.0])

    def loss():
        z = net.forward(data, offsets, keep=True)[0]
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    z, kept = net.forward(data, offsets, keep=True)
    g = net.backward(1 / (1 + np.exp(-z)) - y, kept)
    r = np.random.default_rng(0)
    for name, p in net.p.items():
        flat = p.reshape(-1)
        some = r.choice(np.flatnonzero(g[name].reshape(-1)), 3) if g[name].any() else []
        for i in some:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(g[name].reshape(-1)[i], rel=0.15, abs=2e-3)


def test_sample_is_bounded(spark):
    """Texts are whole; nulls and unlabelled rows are left out; repeated labels count once; rows and bytes are bounded."""
    long = "".join(chr(97 + i % 26) * (1 + i % 7) for i in range(300))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "no label"), (None, "no id"), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (2, 0, None), (3, 1, None), (5, 1, None), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = sorted(_labels.sample(docs, labels, "quality", F.lit(True), 10), key=lambda x: len(x[0]))
    assert got == [("", 1), ("short", 0), (long, 1)]
    assert len(_labels.sample(docs, labels, "quality", F.lit(True), 2)) <= 2
    assert all(len(t) < 50 for t, _ in _labels.sample(docs, labels, "quality", F.lit(True), 10, most_bytes=50))
    assert _labels.sample(docs, labels, "toxic", F.lit(True), 10) == []


def test_training_reads_whole_texts(monkeypatch):
    """What tells the classes apart stands at the end of long texts, of which pieces are taken, and of short ones."""
    monkeypatch.setattr(qc, "LONG", 3000)
    monkeypatch.setattr(qc, "PIECE", 1024)
    r = random.Random(5)
    rows = [(text(r, 900 if i % 3 == 0 else 60) + (" ##%% $$## %%$$ ##$$" if i % 2 else ""), 1 - i % 2) for i in range(240)]
    net, _ = qc.train(rows)
    p = qc.probabilities(pa.array([t for t, _ in rows]), net)
    assert np.mean((p >= 0.5) == np.array([y == 1 for _, y in rows])) >= 0.95
    data = np.frombuffer(rows[0][0].encode(), np.uint8)
    pieces = net.pieces(data)
    whole = net.forward(data, np.array([0, len(data)]))
    some = net.forward(np.concatenate(pieces), np.cumsum([0, *map(len, pieces)]), np.array([0]))
    assert len(pieces) <= qc.HIDDEN and np.abs(whole - some).max() < 1e-4 + 0.2 * np.abs(whole).max()


def test_labels_that_texts_do_not_explain_reject_nothing():
    r = random.Random(4)
    rows = [(text(r, 20), int(i % 5 == 0)) for i in range(50)]
    weights, bias = tx.train(rows)
    assert not weights.any() and 0.1 < tx.probabilities(pa.array(["alpha", "", None]), weights, bias).max() < 0.3


def test_one_huge_text_does_not_empty_the_sample(spark):
    ids = [r.id for r in spark.range(50).orderBy(F.xxhash64("id"), "id").collect()]
    docs = spark.createDataFrame([(i, "x" * 5000 if i == ids[0] else f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    got = _labels.sample(docs, labels, "quality", F.lit(True), 100, most_bytes=1000)
    assert sorted(got) == sorted((f"text {i}", i % 2) for i in ids[1:])
