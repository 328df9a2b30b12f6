"""A toxicity classifier with counterfactual regularisation.

A logistic model over hashed words and word beginnings. In every sentence of a labelled text that names a group of
people, the group terms are swapped for others of the same kind, and the squared change of the sentence's score
that the swap causes is penalised; a text therefore cannot owe its score to the group it mentions,
and neutral mentions are not taken for abuse. `counterfactuals` gives the pairs that the penalty sees; terms of other
languages or kinds can be handed in.

Training uses at most SAMPLE labelled texts; scoring reads each whole text once, without a shuffle.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._labels import fold, sample
from ._shared import mixed, slices, small_batches, utf8
from .decontaminate import _POWERS, Words

SAMPLE = 6_000
_BITS = 20
_STEMS = (5, 7)

#: Terms that name groups of people, by kind; a swap stays within a kind.
IDENTITY = [
    ["women", "men", "girls", "boys", "woman", "man"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"],
    ["black", "white", "asian", "latino", "arab", "african", "european", "american"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["blind", "deaf", "disabled", "autistic"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "atheisten"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "athées"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "ateos"],
]
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def counterfactuals(texts: list[str], terms: list[list[str]] = IDENTITY) -> list[tuple[str, str]]:
    """(sentence, the same with each group term replaced by another of its kind) of each sentence that has a term; the
    choice follows from the sentence, so equal sentences have equal swaps."""
    others = {t: [o for o in group if o != t] for group in terms for t in group if len(group) > 1}
    if not others:
        return []
    term = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(others, key=len, reverse=True))) + r")(?!\w)", re.I)
    out = []
    for t in texts:
        if not term.search(t):
            continue
        for sentence in _SENTENCE.findall(t):
            pick = random.Random(sentence)
            swapped, n = term.subn(lambda m: pick.choice(others.get(m[0].lower(), [m[0]])), sentence)
            if n:
                out.append((sentence, swapped))
    return out


def _hashes(words: Words) -> np.ndarray:
    """(1 + stems) x words: the feature of each word, and of its beginnings; 0 where it is no longer than that."""
    size = words.end - words.start
    rows = [words.hash]
    if len(size):
        n = len(words.raw)
        place = np.arange(words.start[0], n) - np.repeat(words.start, np.diff(np.append(words.start, n)))
        terms = words.raw[words.start[0] :].astype(np.uint64) * _POWERS[place & 0xFFFF]
        for k in _STEMS:
            stem = mixed(np.add.reduceat(np.where(place < k, terms, np.uint64(0)), words.start - words.start[0]) + np.uint64(k))
            rows.append(np.where(size > k, stem, np.uint64(0)))
    else:
        rows += [words.hash] * len(_STEMS)
    return np.stack(rows) >> np.uint64(64 - _BITS)


def _features(texts: pa.Array, weights: np.ndarray | None = None):
    """(rows, features, values) of the texts; with weights, only features that have one.

    A feature's value is its count against the text's length, 1 at most: one chance hit in a long text
    weighs little, one in a short text much."""
    data, offsets = utf8(texts)
    for i, j in slices(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        row = np.repeat(np.arange(i, j), np.diff(words.first))
        feats = _hashes(words)
        row, feats = np.tile(row, len(feats)), feats.ravel()
        keep = feats != 0 if weights is None else weights[feats] != 0
        pair, count = np.unique((row[keep].astype(np.uint64) << np.uint64(_BITS)) | feats[keep], return_counts=True)
        at = (pair >> np.uint64(_BITS)).astype(np.int64)
        size = np.diff(words.first)[at - i]
        yield at, (pair & np.uint64((1 << _BITS) - 1)).astype(np.int64), np.minimum(1.0, count / (1 + size / 100))


def _matrix(texts: list[str]):
    parts = list(_features(pa.array(texts, pa.large_string())))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _telling(row: np.ndarray, feat: np.ndarray, y: np.ndarray, least_z: float) -> np.ndarray:
    """The log odds ratio of the classes' texts that have a feature; 0 where it is within least_z standard
    errors of what chance gives."""
    with_1 = np.bincount(feat, y[row], 1 << _BITS)
    with_0 = np.bincount(feat, 1 - y[row], 1 << _BITS)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((with_1 + 0.5) / (n1 - with_1 + 0.5)) - np.log((with_0 + 0.5) / (n0 - with_0 + 0.5))
    error = np.sqrt(1 / (with_1 + 0.5) + 1 / (with_0 + 0.5) + 1 / (n1 - with_1 + 0.5) + 1 / (n0 - with_0 + 0.5))
    return np.where(np.abs(ratio) >= least_z * error, ratio, 0.0)


def train(rows: list[tuple[str, int]], rounds: int = 200, swap_penalty: float = 1.0, decay: float = 1e-4, least_z: float = 3.5, terms: list[list[str]] = IDENTITY) -> tuple[np.ndarray, float]:
    """(weights, bias). One class only, no rows, or no feature that tells the classes apart, gives the smoothed
    rate and no weights."""
    weights = np.zeros(1 << _BITS)
    y = np.array([r[1] > 0 for r in rows], float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return weights, bias
    texts = [r[0] for r in rows]
    row, feat, value = _matrix(texts)
    ratio = _telling(row, feat, y, least_z)
    seen = ratio != 0
    if not seen.any():
        return weights, bias
    pairs = counterfactuals(texts, terms)
    # of each sentence its features less those of its counterpart: the change of the score is linear in them
    (arow, afeat, avalue), (brow, bfeat, bvalue) = (_matrix([p[k] for p in pairs]) for k in (0, 1))
    srow, sfeat, svalue = np.append(arow, brow), np.append(afeat, bfeat), np.append(avalue, -bvalue)
    keep, skeep = seen[feat], seen[sfeat]
    row, feat, value, srow, sfeat, svalue = row[keep], feat[keep], value[keep], srow[skeep], sfeat[skeep], svalue[skeep]
    value, svalue = value * ratio[feat], svalue * ratio[sfeat]
    ids, inverse = np.unique(np.concatenate([feat, sfeat]), return_inverse=True)
    feat, sfeat = inverse[: len(feat)], inverse[len(feat) :]
    w, sum2, bias2 = np.zeros(len(ids)), np.full(len(ids), 1e-8), 1e-8
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    bias = 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[feat] * value, len(y)) + bias
        g = (1 / (1 + np.exp(-z)) - y) * balance
        grad = np.bincount(feat, g[row] * value, len(ids)) + decay * w
        if len(pairs):
            change = np.bincount(srow, w[sfeat] * svalue, len(pairs))
            grad += np.bincount(sfeat, (2 * swap_penalty / len(pairs) * change)[srow] * svalue, len(ids))
        sum2 += grad**2
        bias2 += g.sum() ** 2
        w -= 0.5 * grad / np.sqrt(sum2)
        bias -= 0.5 * g.sum() / np.sqrt(bias2)
    weights[ids] = w * ratio[ids]
    return weights, float(bias)


def probabilities(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.full(len(texts), bias)
    for row, feat, value in _features(texts, weights):
        z += np.bincount(row, weights[feat] * value, len(texts))
    return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """docs' doc_id and score, one row per row; null and empty texts get the score of no words."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = held.value.astype(np.float64)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probabilities(b.column(1), w, bias))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Trained on at most `most` labelled rows outside held_out (a condition on doc_id)."""
    return train(sample(docs, labels, "toxic", ~held_out, most))


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from a score of 0.5 on).

    Labels are learned only from ids whose crc32 modulo 5 is not 0. Null and empty texts get the score
    of no words; a null doc_id is scored and not held out; repeated rows are scored each for itself;
    other columns are ignored; without labels every score is the same.
    """
    out = F.coalesce(fold(5) == 0, F.lit(False))
    weights, bias = fit(docs, labels, out, most)
    scored = score(docs, weights, bias)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, whose text scores below 0.5; labels as in `classify`."""
    out = F.coalesce(fold(5) == 0, F.lit(False))
    weights, bias = fit(docs, labels, out, most)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    at = docs.columns.index("text")

    def run(batches):
        w = held.value.astype(np.float64)
        for b in batches:
            yield b.filter(pa.array(probabilities(b.column(at).cast(pa.string()), w, bias) < 0.5))

    return docs.mapInArrow(run, docs.schema)
