"""Benchmark decontamination by winnowing.

Words of documents and benchmark items become 64-bit hashes; of every window of WINDOW - GRAM + 1
consecutive GRAM-word hashes the smallest is kept as a fingerprint (winnowing), on both sides. Two
texts that share a span of WINDOW words therefore share a fingerprint at the same place of that span.
Fingerprints are joined, and each hit is extended word by word to the longest match; matches of at
least WINDOW words are hits. An item of fewer than WINDOW words is one window itself and is looked up
by the hash of all its words.

Where the benchmark's measured size is under `broadcast_bytes`, its fingerprints are broadcast and
each document is read once, without a shuffle. Beyond that, fingerprints are joined by a shuffle and
only candidate pairs of document and item are extended.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keyed, mixed, powers, slices, small_batches, utf8, without

WINDOW, GRAM = 10, 5

#: Byte to byte: digits and bytes of non-ASCII characters stay, A-Z become a-z, all else becomes 0.
_TABLE = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _TABLE[_b] = _b
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_POWERS = powers(0x9E3779B97F4A7C15, 1 << 16)


class Words:
    """The words of some rows: bytes [start, end) in `raw`, a hash each, rows' first words in `first`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.raw = _TABLE[data]
        n = len(data)
        word = np.zeros(n + 1, bool)
        word[:n] = self.raw != 0
        begins = word[:n].copy()
        begins[1:] &= ~word[: n - 1] if n else word[:0]
        rows = offsets[:-1][offsets[:-1] < n]
        begins[rows] = word[rows]
        self.start = np.flatnonzero(begins)
        ends = word[:n].copy()
        ends[:-1] &= ~word[1:n] if n else word[:0]
        last = offsets[1:][offsets[1:] > 0] - 1
        ends[last] = word[last]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if len(self.start):
            place = np.arange(self.start[0], n) - np.repeat(self.start, np.diff(np.append(self.start, n)))
            terms = self.raw[self.start[0] :].astype(np.uint64) * _POWERS[place & 0xFFFF]
            self.hash = mixed(np.add.reduceat(terms, self.start - self.start[0]))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """The hash of k words from each word on; the last k-1 places hold no gram."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        return mixed(h)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def within(self, at: np.ndarray, k: int) -> np.ndarray:
        """Of places at: those from which k words lie in one row."""
        return at[at + k <= self.first[self.row_of(at) + 1]]

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.word(x) for x in range(i, j)]


def winnowed(words: Words, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints: in each span of `window` words the k-gram of least hash (the
    leftmost of equals). Spans across rows add fingerprints that do no harm; grams across rows are left out."""
    h = words.grams(k)
    w = window - k + 1
    if len(h) < w:
        at = np.arange(len(h))
    else:
        n = len(h) - w + 1
        least, at = h[:n].copy(), np.arange(n)
        for j in range(1, w):
            less = h[j : j + n] < least
            least[less] = h[j : j + n][less]
            at[less] = np.flatnonzero(less) + j
        at = np.unique(at)
        # spans next to a row's edge may straddle it: keep all grams there
        edges = words.first[1:-1]
        if len(edges):
            near = (edges[:, None] + np.arange(-window, window)).ravel()
            at = np.union1d(at, near[(near >= 0) & (near < len(h))])
    at = words.within(at, k)
    return at, h[at]


class Items:
    """The benchmark, indexed by fingerprints of long items and by whole hashes of short ones."""

    def __init__(self, rows: list[tuple[str, str]]):
        table = pa.array([t for _, t in rows], pa.large_string())
        words = Words(*utf8(table))
        self.ids = [i for i, _ in rows]
        self.words = [words.text(a, b) for a, b in zip(words.first[:-1], words.first[1:])]
        sizes = np.diff(words.first)
        at, h = winnowed(words)
        row = words.row_of(at)
        long = sizes[row] >= WINDOW
        order = np.argsort(h[long], kind="stable")
        self.hash, self.row, self.place = h[long][order], row[long][order], (at - words.first[row])[long][order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in np.unique(sizes[(sizes > 0) & (sizes < WINDOW)]):
            rows_m = np.flatnonzero(sizes == m)
            hm = words.grams(int(m))[words.first[rows_m]]
            order = np.argsort(hm, kind="stable")
            self.short[int(m)] = hm[order], rows_m[order]


def _found(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted table."""
    if not len(table) or not len(h):
        return np.zeros(0, np.int64)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return np.flatnonzero(table[at] == h)


def hits(words: Words, items: Items):
    """(first word, end word, item's row) of the longest matches, by places in words."""
    at, h = winnowed(words)
    done: dict[tuple[int, int], int] = {}
    for x in _found(items.hash, h):
        i = int(at[x])
        row = int(words.row_of(i))
        low, high = int(words.first[row]), int(words.first[row + 1])
        a, b = np.searchsorted(items.hash, h[x], "left"), np.searchsorted(items.hash, h[x], "right")
        for y in range(a, b):
            item, j = int(items.row[y]), int(items.place[y])
            if done.get((item, i - j), -1) >= i + GRAM:
                continue
            theirs = items.words[item]
            left = right = 0
            while i + right < high and j + right < len(theirs) and words.word(i + right) == theirs[j + right]:
                right += 1
            while left < i - low and left < j and words.word(i - left - 1) == theirs[j - left - 1]:
                left += 1
            if right:
                done[item, i - j] = i + right
            if left + right >= WINDOW:
                yield i - left, i + right, item
    for m, (table, rows) in items.short.items():
        h = words.grams(m)
        for i in words.within(_found(table, h), m):
            for y in range(np.searchsorted(table, h[i], "left"), np.searchsorted(table, h[i], "right")):
                if words.text(i, i + m) == items.words[rows[y]]:
                    yield int(i), int(i) + m, int(rows[y])


def _covered(spans) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _sha(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _scan(get_items):
    def run(batches):
        items = get_items()
        for b in batches:
            data, offsets = utf8(b.column("text"))
            cols: dict[str, list] = defaultdict(list)
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                spans, ids = defaultdict(set), defaultdict(set)
                for s, e, item in hits(words, items):
                    row = int(words.row_of(s))
                    spans[row].add((s, e))
                    ids[row].add(items.ids[item])
                for row in range(j - i):
                    n = _covered(spans[row]) if row in spans else 0
                    cols["n_words"].append(int(words.first[row + 1] - words.first[row]))
                    cols["n_hit"].append(n)
                    cols["n_items"].append(len(ids[row]) if row in ids else 0)
                    cols["items_sha256"].append(_sha(ids[row] if row in ids else ()))
                    cols["contaminated"].append(n > 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v) for v in cols.values())], ["doc_id", *cols]) if len(b) else pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]))

    return run


def _prints(id_col: str, lengths):
    """(id, h): distinct fingerprints of each row, and whole hashes at the given short lengths."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            ids = np.arange(len(b))
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes = np.diff(words.first)
                at, h = winnowed(words)
                row = words.row_of(at)
                if id_col == "item_id":
                    row, h = row[sizes[row] >= WINDOW], h[sizes[row] >= WINDOW]
                rows, hs = [row], [h]
                for m in lengths:
                    g = words.grams(m)
                    at = words.within(np.arange(len(g)), m)
                    if id_col == "item_id":
                        at = at[sizes[words.row_of(at)] == m]
                    rows.append(words.row_of(at))
                    hs.append(g[at])
                pairs = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(hs)]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column("rid").take(pa.array(ids[i:j][pairs[0].astype(np.int64)])), pa.array(pairs[1].view(np.int64))], ["rid", "h"])

    return run


def _pairs(batches):
    """Verified spans of pairs of document and item texts."""
    for b in batches:
        out: list[tuple] = []
        for rid, item_id, text, item in zip(*(b.column(c).to_pylist() for c in ("rid", "item_id", "text", "item"))):
            words = Words(*utf8(pa.array([text], pa.large_string())))
            out += [(rid, item_id, s, e) for s, e, _ in hits(words, Items([(item_id, item)]))]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["rid", "item_id", "s", "e"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of WINDOW consecutive words of an item, or of a whole
    shorter item. Null texts have no words; items without words or without an id match nothing; items
    that repeat an id count once. Repeated rows of docs give repeated rows; other columns of either
    table are ignored; an empty benchmark leaves all documents clean.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])
        cache: list[Items] = []

        def get_items():
            if not cache:
                cache.append(Items(held.value))
            return cache[0]

        return docs.mapInArrow(_scan(get_items), _OUT)
    return _by_shuffle(docs, items)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs without the contaminated rows. Rows are told apart by numbers of their own, so ids may repeat or be missing."""
    rows = keyed(docs)
    found = decontaminate(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), benchmark, broadcast_bytes)
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias("rid")), docs.columns)


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    from ._shared import stored

    keyed = stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "docs")
    words = F.size(F.expr("regexp_extract_all(text, '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+', 0)"))
    lengths = sorted(r[0] for r in items.select(words.alias("n")).where(f"n > 0 and n < {WINDOW}").distinct().collect())
    ours = keyed.select("rid", "text").mapInArrow(_prints("rid", lengths), "rid long, h long")
    theirs = items.select(F.col("item_id").alias("rid"), "text").mapInArrow(_prints("item_id", lengths), "rid string, h long").select(F.col("rid").alias("item_id"), "h")
    pairs = ours.join(theirs, "h").select("rid", "item_id").distinct()
    texts = pairs.join(keyed.select("rid", "text"), "rid").join(items.select("item_id", F.col("text").alias("item")), "item_id")
    spans = stored(texts.select("rid", "item_id", "text", "item").mapInArrow(_pairs, "rid long, item_id string, s long, e long"), "spans")
    # one document's spans are bounded by its own words; in order of their starts each adds what lies beyond those before
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    covered = F.aggregate(F.array_sort(F.collect_set(F.struct("s", "e"))), start, step).getField("n")
    per = spans.groupBy("rid").agg(covered.alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("ids"))
    none = F.array().cast("array<string>")
    return (
        keyed.select("rid", "doc_id", F.coalesce(words, F.lit(0)).cast("long").alias("n_words"))
        .join(per, "rid", "left")
        .select(
            "doc_id",
            F.when(F.col("n_words") < 0, 0).otherwise(F.col("n_words")).cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM bs)),
ms AS (SELECT DISTINCT m FROM bs),
dw AS (SELECT r, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS k FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
h AS (SELECT r, p, dw.m, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.m = bw.m),
hw AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS x FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
