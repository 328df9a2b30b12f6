"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight
bytes. Every fingerprint is posted under each choice of four byte positions with the bytes it has
there; members of a posting list share at least those four positional bytes. A pair's shared bytes
are tallied, the pair is retained in the list of its first four shared positions only (so it is
examined once), and it is verified by counting differing bits.

A posting list of more than `list_cap` distinct fingerprints is not compared pair by pair: its
members are linked through midpoints. Fingerprints at most four bits apart have a common value
within two bits of both, and any two that share such a value are at most four bits apart, so
joining the members on all values within two bits gives the same components with a fixed number of
rows for each member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import all_but_first, keyed, small_batches, stored, without

CHOICES = list(combinations(range(8), 4))
_MOST = 4

#: By mask of shared bytes: the number of the choice that holds the first four of them, or 255.
_FIRST = np.full(256, 255, np.uint64)
for _m in range(256):
    _at = tuple(i for i in range(8) if _m >> i & 1)[:4]
    if len(_at) == 4:
        _FIRST[_m] = CHOICES.index(_at)


def fingerprint(text: str | None, size: int = 4) -> int:
    """64-bit SimHash of the space-joined word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(size)))]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), 1 << 16):
        h = np.array([digest(x, 42) for x in shingles[i : i + (1 << 16)]], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(shingles), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of docs."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _post(batches):
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        by = fp.view(np.uint8).reshape(-1, 8).astype(np.uint64)
        for c, at in enumerate(CHOICES):
            key = np.uint64(c << 32) | by[:, at[0]] | by[:, at[1]] << np.uint64(8) | by[:, at[2]] << np.uint64(16) | by[:, at[3]] << np.uint64(24)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])


def _linked(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within the posting lists of one sorted chunk."""
    left, right = [], []
    at = np.arange(len(key))
    for lag in range(1, len(key)):
        at = at[at < len(key) - lag]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        differ = fp[at] ^ fp[at + lag]
        shared = np.packbits(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
        ok = (_FIRST[shared] == key[at] >> np.uint64(32)) & (np.bitwise_count(differ) <= _MOST)
        left.append(fp[at[ok]])
        right.append(fp[at[ok] + lag])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _tally(cap: int):
    def run(batches):
        def out(a, b=None):
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b], ["u", "v"])

        key = fp = np.zeros(0, np.uint64)
        over = None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if over is not None:
                n = int(np.searchsorted(key, over, "right"))
                yield out(fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                over = None
            if not len(key):
                continue
            sizes = np.unique(key, return_counts=True)
            ends = np.cumsum(sizes[1])
            large = np.repeat(sizes[1] > cap, sizes[1])
            last = int(ends[-2]) if len(ends) > 1 else 0
            body = ~large[:last]
            yield out(*_linked(key[:last][body], fp[:last][body]))
            yield out(fp[:last][~body])
            key, fp = key[last:], fp[last:]
            if len(key) > cap:
                yield out(fp)
                over, key, fp = key[0], key[:0], fp[:0]
        yield out(*_linked(key, fp))

    return run


def _midpoints(batches):
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for x in flips:
            yield pa.RecordBatch.from_arrays([pa.array((fp ^ np.uint64(x)).view(np.int64)), b.column(0)], ["mid", "fp"])


def links(fps: DataFrame, list_cap: int = 2048) -> DataFrame:
    """(u, v): links between the distinct fingerprints fps(fp); they give the components of all links."""
    # 16 bytes of shuffle for each of 70 posts; one list holds a fingerprint once, so even a group of
    # copies of a third of the corpus adds at most 1/210 of the posts to one list
    # posted in as many tasks as a shuffle has: 70 times as many rows come out
    wide = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    posts = wide.mapInArrow(_post, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = stored(posts.mapInArrow(_tally(list_cap), "u long, v long"), "simhash")
    dense = found.where("v is null").select(F.col("u").alias("fp")).distinct()
    mids = dense.mapInArrow(_midpoints, "mid long, fp long")
    hubs = mids.groupBy("mid").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v <> top").select("mid", "v")
    near = mids.join(hubs, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return found.where("v is not null").unionByName(near)


def near_duplicates(docs: DataFrame, size: int = 4, list_cap: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most four differing bits. Null and
    wordless texts have fingerprint zero and are linked like any other. Rows with a null doc_id get
    the component of their fingerprint (null where no member has an id). Repeated rows give repeated
    rows; other columns of docs are ignored; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, size), "fingerprints")
    # equal fingerprints first become one, so that exact copies never meet pairwise
    reps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "reps")
    roots = stored(connected_components(links(reps, list_cap)), "roots")
    members = roots.join(reps, roots["node"] == reps["fp"]).select("fp", "root", "first")
    lowest = members.groupBy("root").agg(F.min("first").alias("component"))
    linked = members.join(lowest, "root").select(F.col("fp").alias("node"), "component")
    # stored, so that the exchange of the rows stands directly below the join and a very common fingerprint is split
    named = stored(reps.join(linked, reps["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id")), "named")
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 4, list_cap: int = 2048) -> DataFrame:
    """docs with one row of each near-duplicate group: that of least doc_id (nulls last), of equal ids any one. Rows
    are told apart by numbers of their own, so ids may repeat or be missing."""
    rows = keyed(docs)
    found = near_duplicates(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), size, list_cap)
    named = found.select(F.col("doc_id").alias("rid"), F.col("component_id").alias("root"))
    groups = stored(named.join(rows.select("rid", F.col("row.doc_id").cast("long").alias("id")), "rid").select("rid", "id", "root"), "groups")
    return without(rows, all_but_first(groups), docs.columns)
