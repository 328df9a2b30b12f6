"""Near copies by shingle similarity: a wide SimHash index finds candidates, exact Jaccard similarity decides.

A pair of similarity 0.8 has SimHash bits that differ in about 15 of 100 places, too many for the radius of
`simhash_dedup`. Here a fingerprint has GROUPS groups of four bytes and is posted under each pair of byte
positions of each group, with the bytes it has there: two texts are compared if two bytes of a group are equal.

Before that, texts that cannot have a near copy go, by an exact bound: of the shingles of least hash of two similar
texts, some are in both (`head`), so a text is posted only if enough of its own occur in another text. Posted texts are as
many as share passages with others, not as many as the corpus has.

Two posts of a list are candidates if their 128-bit sketches differ in at most MOST bits, and sizes and shingle counts
allow the similarity (exact bounds, `_close`). Candidates are verified by the Jaccard similarity of their sets of word
shingles, so no link is ever wrong; what the index misses is in the README.

Lists are read twice. First each text is linked to the least text of the list and one of those shortly before it, and of
these links each text verifies two at most. Then posts are made again, with the roots that these links gave, and all
candidates of different roots are verified. A group of near copies thus costs rows in proportion to its size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import all_but_first, dropped, mixed, small_batches, stored, utf8, without

SIZE, SIMILARITY = 5, 0.8
GROUPS = 20
MOST = 42
#: Texts before it in a list that a text is compared with in the first reading, besides the list's least.
LIST_CAP = 8
#: Counters of a text's shingles, two to a byte; the part of a text's shingles that similar texts share in their heads.
COUNTERS, SHARED = 128, 0.05
#: Posts of a list that are compared by shifts; longer lists text by text.
_SHORT = 64
_WORDS = GROUPS // 2  # 64-bit words of a fingerprint
_SALT = np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_PAIRS = [(4 * g + a, 4 * g + b) for g in range(GROUPS) for a, b in combinations(range(4), 2)]
_BUFFER = 1 << 15
_PRINT = 16 + COUNTERS // 2
_POSTS = "key long, root long, node long, n int, print binary"
_ROUND = np.minimum(np.arange(16), 16 - np.arange(16)).astype(np.uint8)
_SLACK = 1e-6


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> set[bytes]:
    """The distinct space-joined shingles; fewer words than `size` are one shingle, no words none."""
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(x) for x in zip(*(words[i:] for i in range(size)))}


def similar(a: set, b: set, least: float) -> bool:
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, shingles(words, size)), np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """GROUPS * 4 bytes of SimHash over the hashes of the distinct shingles."""
    votes = np.zeros(64 * _WORDS, np.int64)
    for i in range(0, len(h), 1 << 12):
        bits = mixed((h[i : i + (1 << 12), None] ^ _SALT[None, :]).ravel()).view(np.uint8).reshape(-1, 8 * _WORDS)
        votes += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(votes * 2 > len(h), bitorder="little")


def counters(h: np.ndarray) -> np.ndarray:
    """How many hashes have each remainder by COUNTERS, modulo 16, two to a byte."""
    c = np.bincount((mixed(h) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) & 15
    return (c[0::2] | c[1::2] << 4).astype(np.uint8)


def head(h: np.ndarray, least: float) -> np.ndarray:
    """The least hashes of a text: as many as can be in no similar text, and SHARED of all. Let k be SHARED of the smaller
    text's; the k least of the hashes that are in both texts are then in both heads, and k is at least
    SHARED * least of either text's: `_needed` of each text's head are in another's."""
    k = min(len(h), len(h) - math.ceil(least * len(h) - _SLACK) + math.ceil(SHARED * len(h)))
    return np.partition(h, k - 1)[:k] if k else h


def _needed(n, least: float):
    return F.greatest(F.lit(1), F.floor(n * F.lit(SHARED * least)))


def _prints(size: int, least: float):
    def run(batches):
        for b in batches:
            nodes, n, fps, heads = [], [], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                h = _hashes(words, size)
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                n.append(len(h))
                fps.append(wide_fingerprint(h).tobytes() + counters(h).tobytes())
                heads.append(head(h, least).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fps, pa.binary()), pa.array(heads, pa.binary())], ["row", "node", "n", "fp", "head"])

    return run


def _heads(batches):
    for b in batches:
        data, offsets = utf8(b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), np.diff(offsets) // 8))], ["h", "node"])


def _post(batches):
    """Posts of texts(root, node, n, fp)."""
    for b in batches:
        if not len(b):
            continue
        by = utf8(b.column(3))[0].reshape(len(b), -1)
        width = 4 * GROUPS
        prints = np.ascontiguousarray(np.concatenate([by[:, :16], by[:, width:]], axis=1))
        prints = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.arange(0, prints.size + 1, _PRINT, dtype=np.int32)), pa.py_buffer(prints)])
        wide = by[:, :width].astype(np.int64)
        for c, (x, y) in enumerate(_PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(c << 16 | wide[:, x] << 8 | wide[:, y]), b.column(0), b.column(1), b.column(2), prints], ["key", "root", "node", "n", "print"])


def _tables(batches):
    """Sorted posts as (key, root, node, n, sketch, counters), some _BUFFER rows at a time."""
    parts, rows = [], 0
    for b in batches:
        if not len(b):
            continue
        by = utf8(b.column("print"))[0].reshape(len(b), _PRINT)
        parts.append((*(b.column(c).to_numpy() for c in ("key", "root", "node", "n")), np.ascontiguousarray(by[:, :16]).view(np.uint64), by[:, 16:]))
        rows += len(b)
        if rows >= _BUFFER:
            yield _joined(parts)
            parts, rows = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts):
    return tuple(np.concatenate(x) for x in zip(*parts))


def _at(table, i):
    return tuple(x[i] for x in table)


def _close(a, b, least: float) -> np.ndarray:
    """Which rows of the table a may be similar to those of b, rows beside them or one row. Sizes: the smaller set is at
    least that part of the larger. Counters: sets that are similar differ in at most (1 - least) / (1 + least) of
    both sizes, and counters (of remainders, the shorter way round) never differ by more than the sets do."""
    alone = b[4].ndim == 1
    k = np.flatnonzero(np.bitwise_count(a[4] ^ b[4]).sum(axis=-1, dtype=np.int64) <= MOST)
    n, m = a[3][k].astype(np.float64), (b[3] if alone else b[3][k]).astype(np.float64)
    ok = np.minimum(n, m) >= least * np.maximum(n, m) - _SLACK
    k, most = k[ok], ((n + m) * (1 - least) / (1 + least) + _SLACK)[ok]
    found = np.zeros(len(a[3]), bool)
    for i in range(0, len(k), 1 << 14):
        j = k[i : i + (1 << 14)]
        x, y = a[5][j], b[5] if alone else b[5][j]
        found[j] = _ROUND[(x - y) & 15].sum(axis=1, dtype=np.int64) + _ROUND[((x >> 4) - (y >> 4)) & 15].sum(axis=1, dtype=np.int64) <= most[i : i + (1 << 14)]
    return found


def _pairs(u, v):
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _nearby(cap: int, least: float):
    """Of posts sorted by key and node, each text with its list's least, and with the last candidate of the `cap` before."""

    def run(batches):
        old = None
        for table in _tables(batches):
            done = 0
            if old is not None:
                done, table = len(old[0]), _joined([old, table])
            key, node = table[0], table[2]
            new = np.append(True, key[1:] != key[:-1])
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            at = np.arange(done, len(key))
            at = at[at > start[at]]
            ok = at[_close(_at(table, at), _at(table, start[at]), least)]
            yield _pairs(node[ok], node[start[ok]])
            for lag in range(1, cap + 1):
                at = at[at - lag > start[at]]
                if not len(at):
                    break
                ok = _close(_at(table, at), _at(table, at - lag), least)
                yield _pairs(node[at[ok]], node[at[ok] - lag])
                at = at[~ok]
            first = int(start[-1])
            old = _at(table, np.append(first, np.arange(max(first + 1, len(key) - cap), len(key))))

    return run


def _across(least: float):
    """Of posts sorted by key, all candidates whose roots differ."""

    def short(table):
        key, root, node = table[:3]
        at = np.arange(len(key))
        for lag in range(1, _SHORT):
            at = at[at < len(key) - lag]
            at = at[key[at] == key[at + lag]]
            if not len(at):
                return
            apart = at[root[at] != root[at + lag]]
            ok = apart[_close(_at(table, apart), _at(table, apart + lag), least)]
            yield _pairs(node[ok], node[ok + lag])

    def long(table):
        table = _at(table, np.argsort(table[1], kind="stable"))
        root = table[1]
        starts = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
        runs = sorted(zip(np.diff(np.append(starts, len(root))).tolist(), starts.tolist()))
        table = _at(table, np.concatenate([np.arange(a, a + m) for m, a in runs]))
        node, at = table[2], 0
        for m, _ in runs[:-1]:
            rest = _at(table, slice(at + m, None))
            for i in range(at, at + m):
                ok = _close(rest, _at(table, i), least)
                if ok.any():
                    yield _pairs(rest[2][ok], np.full(ok.sum(), node[i]))
            at += m

    def whole(table):
        starts = np.flatnonzero(np.append(True, table[0][1:] != table[0][:-1]))
        sizes = np.diff(np.append(starts, len(table[0])))
        yield from short(_at(table, np.repeat(sizes <= _SHORT, sizes)))
        for a, m in zip(starts[sizes > _SHORT].tolist(), sizes[sizes > _SHORT].tolist()):
            yield from long(_at(table, slice(a, a + m)))

    def run(batches):
        parts = []  # the last of them may hold the begin of a list that goes on
        for table in _tables(batches):
            if parts and table[0][-1] == parts[0][0][-1]:
                parts.append(table)
                continue
            table = _joined([*parts, table])
            end = int(np.searchsorted(table[0], table[0][-1]))
            if end:
                yield from whole(_at(table, slice(0, end)))
            parts = [_at(table, slice(end, None))]
        if parts:
            yield from whole(_joined(parts))

    return run


def _verify(size: int, least: float):
    def run(batches):
        for b in batches:
            cache: dict = {}

            def of(node, text):
                if node not in cache:
                    cache[node] = shingles(words_of(text), size)
                return cache[node]

            keep = [similar(of(u, x), of(v, y), least) for u, v, x, y in zip(*(b.column(c).to_pylist() for c in ("u", "v", "x", "y")))]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _posted(texts: DataFrame) -> DataFrame:
    return texts.select("root", "node", "n", "fp").mapInArrow(_post, _POSTS).repartition("key").sortWithinPartitions("key", "node")


def near_copies(rows: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, list_cap: int = LIST_CAP) -> DataFrame:
    """(node, root) of the texts that have near copies, of rows(node, n, fp, head, text, rid): the least node that links reach."""
    small_batches(rows.sparkSession)
    reps = stored(rows.groupBy("node").agg(F.min("rid").alias("rid"), *(F.first(c).alias(c) for c in ("n", "fp", "head"))), "reps")
    heads = stored(reps.select("node", "head").mapInArrow(_heads, "h long, node long"), "heads")
    met = stored(heads.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "met")
    shared = stored(heads.join(met, "h", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("c")), "shared")
    dropped(heads, met)
    some = stored(reps.join(shared, "node").where(F.col("c") >= _needed(F.col("n"), similarity)).select("node", "rid", "n", "fp"), "some")
    dropped(reps, shared)

    def verified(pairs):
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        texts = stored(rows.join(ends.join(some, "node").select("rid"), "rid", "left_semi").select("node", "text"), "texts")
        both = pairs.join(texts.toDF("u", "x"), "u").join(texts.toDF("v", "y"), "v").select("u", "v", "x", "y")
        out = stored(both.mapInArrow(_verify(size, similarity), "u long, v long"), "verified")
        dropped(texts)
        return out

    near = _posted(some.withColumn("root", F.col("node"))).mapInArrow(_nearby(list_cap, similarity), "u long, v long")
    near = near.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    good = verified(stored(near.select("u", F.explode(F.array_distinct(F.array("a", "b"))).alias("v")), "pairs"))
    roots = stored(connected_components(good), "roots")
    named = stored(some.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", "n", "fp"), "named")
    more = stored(_posted(named).mapInArrow(_across(similarity), "u long, v long").distinct(), "pairs")
    dropped(named)
    return stored(connected_components(good.unionByName(verified(more))), "roots")


def keep_one(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, list_cap: int = LIST_CAP) -> DataFrame:
    """docs with one row of each group of near copies: that of least doc_id (nulls last), of equal ids any one. Rows
    are told apart by numbers of their own, so ids may repeat or be missing. Texts of equal words are copies,
    wordless ones too."""
    small_batches(docs.sparkSession)
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).select("row", F.col("row.text").cast("string").alias("text"))
    prints = row.mapInArrow(_prints(size, similarity), "row " + docs.schema.simpleString() + ", node long, n int, fp binary, head binary")
    rows = stored(prints.select("row", "node", "n", "fp", "head", F.monotonically_increasing_id().alias("rid")), "rows")
    roots = near_copies(rows.select("node", "n", "fp", "head", "rid", F.col("row.text").cast("string").alias("text")), size, similarity, list_cap)
    ids = rows.select("rid", F.col("row.doc_id").cast("long").alias("id"), "node")
    groups = stored(ids.join(roots, "node", "left").select("rid", "id", F.coalesce("root", "node").alias("root")), "groups")
    return without(rows, all_but_first(groups), docs.columns)
