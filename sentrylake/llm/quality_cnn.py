"""A byte-level convolutional network, in numpy, that scores the quality of whole texts.

Bytes are embedded; learned filters slide over them; their activations are max-pooled over overlapping chunks (two
blocks of BLOCK bytes, moved by one block) that cover the whole text; a hidden layer reads each chunk, and its maximum
over all chunks is combined into one probability.

Training uses at most SAMPLE labelled texts, each of which every round reads as a whole. Of a text of more than LONG
bytes only the pieces that give a hidden unit its maximum are kept for the gradient, which is that of the whole text,
as it flows through maxima only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._labels import fold, sample
from ._shared import slices, small_batches, utf8

SAMPLE = 2_500
BLOCK, WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 256, 9, 3, 8, 32, 16
LONG, PIECE = 1 << 18, 1 << 14
_STEPS = BLOCK // STRIDE + 1  # places of a filter in a block; the last reaches into the next block


def _laid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in whole blocks: bytes (blocks x BLOCK), the bytes that each block really has, first block of each text."""
    size = np.diff(offsets)
    blocks = np.maximum(1, -(-size // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[first[i] * BLOCK : first[i] * BLOCK + b - a] = data[a:b]
    inside = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    filled = np.clip(np.repeat(size, blocks) - inside * BLOCK, 0, BLOCK)
    return out, filled, first


class Net:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        w = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "embed": w(256, DIM, scale=0.5),
            "filters": w(WIDTH * DIM, FILTERS, scale=0.2),
            "fbias": np.zeros(FILTERS, np.float32),
            "hidden": w(FILTERS, HIDDEN, scale=0.2),
            "hbias": np.full(HIDDEN, 0.1, np.float32),
            "out": w(HIDDEN, scale=0.3),
            "obias": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0

    def forward(self, data: np.ndarray, offsets: np.ndarray, texts: np.ndarray | None = None, keep: bool = False):
        """The maximum of each row's chunks or, where texts have several rows each, from rows `texts` on, of each
        text's; with keep the logits and what `backward` needs."""
        p = self.p
        raw, filled, first = _laid(data, offsets)
        x = p["embed"][raw]
        n = int(first[-1])
        places = (np.arange(n)[:, None] * BLOCK + np.arange(_STEPS) * STRIDE).ravel()
        whole = np.lib.stride_tricks.as_strided(x, (len(raw) - WIDTH + 1, WIDTH * DIM), x.strides)
        cols = np.lib.stride_tricks.as_strided(x, (n, _STEPS, WIDTH * DIM), (x.strides[0] * BLOCK, x.strides[0] * STRIDE, x.strides[1]))
        act = np.maximum(cols.reshape(n * _STEPS, -1) @ p["filters"] + p["fbias"], 0).reshape(n, _STEPS, FILTERS)
        act *= (np.arange(_STEPS) * STRIDE < np.maximum(filled, 1)[:, None])[:, :, None]
        top = act.max(1)
        # chunk c is blocks c and c + 1 of one row; a row's last block, if not its first, starts no chunk
        blocks = np.diff(first)
        starts = np.ones(n, bool)
        starts[first[1:] - 1] = blocks == 1
        a = np.flatnonzero(starts)
        b = np.where(np.repeat(blocks, blocks)[a] == 1, a, np.minimum(a + 1, n - 1))
        v = np.maximum(top[a], top[b])
        h = np.maximum(v @ p["hidden"] + p["hbias"], 0)
        chunk_first = np.concatenate([[0], np.cumsum(np.maximum(1, blocks - 1))])
        if texts is not None:
            chunk_first = np.append(chunk_first[texts], chunk_first[-1])
        doc = np.maximum.reduceat(h, chunk_first[:-1], axis=0)
        if not keep:
            return doc
        z = doc @ p["out"] + p["obias"][0]
        return z, (raw, whole, places, act, top, a, b, v, h, chunk_first, doc)

    def backward(self, dz: np.ndarray, kept) -> dict:
        p = self.p
        raw, whole, places, act, top, a, b, v, h, chunk_first, doc = kept
        g = {"out": doc.T @ dz, "obias": dz.sum(keepdims=True)}
        ddoc = dz[:, None] * p["out"]
        owner = np.repeat(np.arange(len(dz)), np.diff(chunk_first))
        is_top = (h == doc[owner]) & (h > 0)
        share_top = np.add.reduceat(is_top, chunk_first[:-1], axis=0)
        dh = is_top * (ddoc / np.maximum(share_top, 1))[owner]
        g["hidden"], g["hbias"] = v.T @ dh, dh.sum(0)
        dtop = dh @ p["hidden"].T
        from_a = top[a] >= top[b]
        f = np.arange(FILTERS)
        grads = np.zeros((len(act), FILTERS), np.float32)
        np.add.at(grads, a, dtop * from_a)
        np.add.at(grads, b, dtop * ~from_a)
        live = np.flatnonzero((grads != 0).any(1))
        best = act[live].argmax(1)
        d = np.where(top[live] > 0, grads[live], 0)
        # each filter of a block reaches one place only
        at = places.reshape(len(act), _STEPS)[live[:, None], best].ravel()
        filters, weight = np.tile(f, len(live)), d.ravel()
        some = np.flatnonzero(weight)
        at, filters, weight = at[some], filters[some], weight[some]
        cols = whole[at]
        g["filters"], g["fbias"] = np.zeros_like(p["filters"]), np.bincount(filters, weight, FILTERS).astype(np.float32)
        for k in range(FILTERS):
            mine = filters == k
            g["filters"][:, k] = weight[mine] @ cols[mine]
        dcols = (weight[:, None] * p["filters"].T[filters]).reshape(-1, WIDTH, DIM)
        letters = raw[at[:, None] + np.arange(WIDTH)].ravel()
        dcols = dcols.reshape(-1, DIM)
        g["embed"] = np.stack([np.bincount(letters, dcols[:, i], 256) for i in range(DIM)], axis=1).astype(np.float32)
        g["embed"][0] = 0
        return g

    def pieces(self, data: np.ndarray) -> list[np.ndarray]:
        """A long text's pieces, which share a block so that each chunk lies in one, that hold the maximum of a hidden unit."""
        cut = _pieces(len(data), PIECE)
        tops = np.concatenate([self.forward(data[x:y], np.array([0, y - x])) for x, y in cut])
        return [data[x:y] for x, y in (cut[i] for i in sorted(set(tops.argmax(0).tolist())))]


def _pieces(n: int, size: int) -> list[tuple[int, int]]:
    step = size // BLOCK * BLOCK
    return [(x, min(n, x + step + BLOCK)) for x in range(0, max(1, n - BLOCK), step)]


def train(rows: list[tuple[str, int]], rounds: int = 6, batch: int = 32, rate: float = 4e-3, seed: int = 0) -> tuple[Net | None, float]:
    """(network, 0), or (None, log odds of the smoothed rate) where the rows have one class only."""
    y = np.array([r[1] > 0 for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        return None, float(np.log(share / (1 - share)))
    texts = [np.frombuffer(r[0].encode("utf-8"), np.uint8) for r in rows]
    net, pick = Net(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    rounds = max(rounds, -(-300 * batch // len(y)))  # few rows are read more often
    total = rounds * -(-len(y) // batch)
    # the rarer class is shown so often that it makes a third of each round at least
    rare = np.flatnonzero(y == (y.mean() < 0.5))
    more = max(0, int((len(y) - 3 * len(rare)) / 2))
    odds = np.float32(np.log((len(rare) + more) / len(rare))) * (1 if y.mean() < 0.5 else -1)
    for _ in range(rounds):
        order = pick.permutation(np.concatenate([np.arange(len(y)), pick.choice(rare, more)]) if more else np.arange(len(y)))
        total = max(total, rounds * -(-len(order) // batch))
        for i in range(0, len(order), batch):
            ids = order[i : i + batch]
            parts = [net.pieces(texts[t]) if len(texts[t]) > LONG else [texts[t]] for t in ids]
            first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])[:-1]
            rows_of = [x for part in parts for x in part]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows_of])])
            z, kept = net.forward(np.concatenate(rows_of), offsets, first, keep=True)
            dz = ((1 / (1 + np.exp(-z)) - y[ids]) / len(ids)).astype(np.float32)
            step += 1
            lr = rate * min(1, step / 50) * (1 - 0.95 * step / total)
            for k, g in net.backward(dz, kept).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                net.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
            net.p["embed"][0] = 0
    net.p["obias"] = net.p["obias"] - odds
    return net, 0.0


def probabilities(texts: pa.Array, net: Net, segment: int = 1 << 18) -> np.ndarray:
    """Long texts are read in segments that share a block, so that each chunk lies in one."""
    data, offsets = utf8(texts)
    z = np.empty(len(texts))
    for i, j in slices(offsets, segment):
        a, b = int(offsets[i]), int(offsets[j])
        if j == i + 1 and b - a > segment + BLOCK:
            parts = [net.forward(data[a + x : a + y], np.array([0, y - x])) for x, y in _pieces(b - a, segment)]
            doc = np.max(parts, axis=0)
        else:
            doc = net.forward(data[a:b], offsets[i : j + 1] - a)
        z[i:j] = doc @ net.p["out"] + net.p["obias"][0]
    return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, net: Net | None, constant: float = 0.0) -> DataFrame:
    """docs' doc_id and score, one row per row of docs."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net.p if net else None)

    def run(batches):
        made = Net()
        made.p = held.value
        for b in batches:
            p = probabilities(b.column(1), made) if made.p else np.full(len(b), 1 / (1 + np.exp(-constant)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from a score of 0.7 on).

    Labels are learned only from ids whose crc32 modulo 4 is not 2. Null and empty texts get the score of
    no bytes; a null doc_id is scored and not held out; repeated rows are scored each for itself; other
    columns are ignored; without labels every score is the same.
    """
    out: Column = F.coalesce(fold(4) == 2, F.lit(False))
    net, constant = train(sample(docs, labels, "quality", ~out, most))
    return score(docs, net, constant).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
