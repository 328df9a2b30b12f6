"""Removal of repeated byte strings, found by suffix arrays that are built by two-stage sorting.

A string of LENGTH bytes is removed wherever it starts if it starts more than once in the corpus.

1. Every LENGTH-byte window of a text is assigned to its anchor, the GRAM-byte string of least hash
   in it (the leftmost of equals). Equal windows have equal anchors at the same place. Consecutive
   windows of one anchor are one occurrence, with the anchor's hash as key and the hash of all bytes
   that its windows cover as context.
2. Occurrences are counted by key and context, before any text is sent. A key that occurs once repeats
   nothing; a context that occurs twice repeats all its windows.
3. A key with more than `key_cap` contexts, which would make one large array, is dealt anew: windows that
   start within the same few bytes before the anchor share a core of almost LENGTH bytes, whose hash is
   the new key of that part of the context. Parts are counted as occurrences are, so that a passage of
   many documents becomes counts and no group of rows; keys still over the cap are dealt by a longer
   core, until the core is the window itself, whose key has one context only.
4. One text of each context goes to the suffix arrays wherever a key has several contexts, `key_cap` at
   most: these are sorted together, the common prefixes of neighbours are computed, and windows whose
   common prefix reaches LENGTH are repeated.
5. The decisions are joined back to the occurrences by key and context, and to the texts.

Repeated passages can be found by words as well: the text is then read as one code of CODE bytes for each word (what
stands between ASCII white space), and all the above counts in codes instead of bytes, so that WORDS consecutive words
are a string of WORDS codes, whatever their length. Spans of codes become the bytes from the first word's start to the
last word's end.

Texts are named by a 128-bit digest of their bytes throughout, so that repeated rows and missing or
repeated ids are harmless, and a recomputed task gives the same names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, small_batches, stored, utf8

LENGTH, GRAM = 400, 32
LEADS = 1 << 20
#: Contexts of one suffix array at most.
KEY_CAP = 512
#: Widths of the parts into which the windows of a key over the cap are dealt, one after the other.
CELLS = (32, 4, 1)
_SEGMENT = 1 << 20
#: Passages of over 50 words; bytes of a word's code; the codes of an anchor.
WORDS, CODE, WORD_GRAM = 51, 4, 8
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- suffix arrays -------------------------------------------------------------------------------


def two_stage_order(texts: list[bytes], starts: list[int], depth: int, groups: list[int] | None = None, unit: int = 1) -> np.ndarray:
    """(text, place) rows of the suffixes at places [0, starts[t]) of every text t, in the order of their first
    `depth` symbols; equal ones are adjacent. A symbol is `unit` bytes. With groups (a number for each text,
    ascending) the order is that of a suffix array for each group, one after the other; all are built in the same passes.

    Suffixes smaller than their successors are sorted directly. Each other suffix is larger than its
    successor and is induced from it: the buckets of first symbols are scanned in order, and what precedes a
    suffix goes to the end of the larger kind's part of its own bucket. A text's end is the smallest suffix.
    """
    whole = b"".join(texts)
    symbols, data = (np.arange(256), np.frombuffer(whole, np.uint8)) if unit == 1 else np.unique(np.frombuffer(whole, ">u4"), return_inverse=True)
    ends = np.cumsum([len(t) // unit for t in texts])
    base = ends - [len(t) // unit for t in texts]
    n = len(data)
    if not n:
        return np.zeros((0, 2), np.int64)
    last = np.zeros(n, bool)
    last[ends[ends > base] - 1] = True
    turn = last.copy()
    turn[:-1] |= data[:-1] != data[1:]
    turns = np.flatnonzero(turn)
    after = turns[np.searchsorted(turns, np.arange(n))]
    smaller = ~last[after] & (data[after] < data[np.minimum(after + 1, n - 1)])
    members, stop = np.zeros(n + 1, bool), []
    small_at = np.flatnonzero(smaller)
    first_small = np.searchsorted(small_at, base + np.maximum(starts, 0))
    for t, k in enumerate(starts):
        if k <= 0:
            continue
        # the chain of larger suffixes after the last wanted one ends at a directly sorted one or the text's end
        i = int(first_small[t])
        top = int(small_at[i]) + 1 if i < len(small_at) and small_at[i] < ends[t] else int(ends[t])
        members[base[t] : top] = True
        if top == ends[t] and not smaller[top - 1]:
            stop.append(top - 1)
    owner = np.repeat(np.arange(len(texts)), ends - base)
    direct = np.flatnonzero(members[:n] & smaller)
    group = np.asarray(groups)[owner] if groups is not None else np.zeros(n, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group[direct])) + 1).tolist(), len(direct)]
    limit = np.minimum(direct + depth, ends[owner[direct]]).tolist()
    direct = direct.tolist()
    words = [whole[unit * i : unit * j] for i, j in zip(direct, limit)]
    first = data.tolist()
    large: list[list[int]] = [[] for _ in symbols]
    small: list[list[int]] = [[] for _ in symbols]
    for x, y in zip(cuts[:-1], cuts[1:]):
        for i in sorted(range(x, y), key=words.__getitem__):
            small[first[direct[i]]].append(direct[i])
    del words
    # places that a larger, wanted suffix of the same text precedes
    led = np.zeros(n, bool)
    led[1:] = members[: n - 1] & ~smaller[: n - 1]
    led[base[ends > base]] = False
    led = led.tobytes()
    for i in stop:  # before the empty suffix
        large[first[i]].append(i)
    out: list[int] = []
    for c in range(len(symbols)):
        for part in (large[c], small[c]):
            for i in part:  # a large part grows while it is scanned
                if led[i]:
                    large[first[i - 1]].append(i - 1)
            out += part
    got = np.array(out, np.int64)
    got = got[np.argsort(group[got], kind="stable")]
    t = owner[got]
    place = got - base[t]
    keep = place < np.asarray(starts)[t]
    return np.stack([t[keep], place[keep]], axis=1)


def common_prefixes(whole: bytes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The length of the common prefix of whole[a[i]:] and whole[b[i]:], `most` at most; both reach that far."""
    data = np.frombuffer(whole + bytes(8), np.uint8)
    eight = np.ndarray((len(whole) + 1,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    out, live = np.full(len(a), most, np.int64), np.arange(len(a))
    for x in range(0, most, 8):
        differ = eight[a[live] + x] ^ eight[b[live] + x]
        at = np.flatnonzero(differ)
        # the lowest set bit lies in the first byte that differs
        bit = np.bitwise_count((differ[at] & (~differ[at] + np.uint64(1))) - np.uint64(1))
        out[live[at]] = np.minimum(most, x + bit.astype(np.int64) // 8)
        live = live[differ == 0]
        if not len(live):
            break
    return out


def repeated_places(texts: list[bytes], starts: list[int], length: int, groups: list[int] | None = None, unit: int = 1) -> list[np.ndarray]:
    """For each text the places below starts[t] whose first `length` symbols start at another place too; each such
    place has that many. Equal strings are looked for within groups."""
    order = two_stage_order(texts, starts, length, groups, unit)
    base = np.concatenate([[0], np.cumsum([max(k, 0) for k in starts])])
    mark = np.zeros(int(base[-1]), bool)
    if len(order) > 1:
        t, place = order[:, 0], order[:, 1]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])])[t] + unit * place
        prefix = common_prefixes(b"".join(texts), begin[:-1], begin[1:], unit * length)
        near = prefix >= unit * length
        if groups is not None:
            near &= np.asarray(groups)[t[:-1]] == np.asarray(groups)[t[1:]]
        at = base[t] + place
        mark[at[:-1][near]] = mark[at[1:][near]] = True
    return [np.flatnonzero(mark[x:y]) for x, y in zip(base[:-1], base[1:])]


# --- words ---------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    turns = np.flatnonzero(word[1:] != word[:-1])
    return turns[::2], turns[1::2]


def _coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words as codes, and the offsets of the rows' codes."""
    codes, sizes = [np.zeros(0, "<u4")], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        words = data[a:b].tobytes().split()
        codes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).astype("<u4"))
        sizes.append(len(words))
    return np.concatenate(codes), np.cumsum(sizes)


# --- anchors -------------------------------------------------------------------------------------


def _doubled(h: np.ndarray, by: int) -> np.ndarray:
    out = h[:-by] * _M1
    out += h[by:]
    out ^= out >> np.uint64(29)
    out *= _M2
    return out


def _anchors(raw: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window the place of its anchor."""
    h, s = raw.astype(np.uint64) + np.uint64(1), 1
    while s < gram:
        h, s = _doubled(h, s), 2 * s
    mask = np.uint64((1 << 22) - 1)
    least, s, w = (h & ~mask) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while 2 * s <= w:
        least, s = np.minimum(least[:-s], least[s:]), 2 * s
    if w > s:
        least = np.minimum(least[: len(least) - (w - s)], least[w - s :])
    return h, (least & mask).astype(np.int64)


def _parts(offsets: np.ndarray, length: int):
    """(first row, end row, first byte, end byte, end of starts): runs of rows, or overlapping segments of a long row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > _SEGMENT:
            for a in range(int(offsets[i]), int(offsets[i + 1]), _SEGMENT):
                yield i, i + 1, a, min(a + _SEGMENT + length - 1, int(offsets[i + 1])), min(a + _SEGMENT, int(offsets[i + 1]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SEGMENT, "right")) - 1)
        yield i, j, int(offsets[i]), int(offsets[j]), int(offsets[j])
        i = j


def _names(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each text, of a digest of its bytes."""
    whole = data.tobytes()
    digests = b"".join(xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:]))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _occurrences(length: int, gram: int, words: bool = False):
    """(t1, t2, key, ctx, s, n): occurrences, in bytes or codes; s is the first window's start in the text, n holds
    how many windows there are (times LEADS) and how far before its anchor the first starts."""
    unit = CODE if words else 1

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(0))
            names = _names(data, offsets)
            if words:
                data, offsets = _coded(data, offsets)
            for i, j, a, z, stop in _parts(offsets, length):
                if z - a < length:
                    continue
                raw = data[a:z]
                h, at = _anchors(raw, gram, length)
                start = np.arange(len(at))
                edge = offsets[i : j + 1] - a
                row = np.repeat(np.arange(j - i), np.diff(np.clip(edge, 0, len(raw))))[: len(start)]
                ok = (start + length <= edge[row + 1]) & (start < stop - a)
                start, row, at = start[ok], row[ok], at[ok]
                if not len(start):
                    continue
                new = np.ones(len(start), bool)
                new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(start)))
                s, at, row = start[first], at[first], row[first]
                whole = raw.tobytes()
                ctx = np.array([xxhash.xxh3_64_intdigest(whole[unit * x : unit * (x + k + length - 1)], int(p - x)) for x, k, p in zip(s.tolist(), count.tolist(), at.tolist())], np.uint64)
                name = names[i + row]
                cols = (name[:, 0], name[:, 1], h[at].view(np.int64), ctx.view(np.int64), s + a - offsets[i + row], count * LEADS + (at - s))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["t1", "t2", "key", "ctx", "s", "n"])

    return run


_OCC = "t1 long, t2 long, key long, ctx long, s long, n long"


# --- the operator --------------------------------------------------------------------------------


def _texts(batches):
    """(t1, t2, text): the distinct texts of each batch."""
    for b in batches:
        data, offsets = utf8(b.column(0))
        names = _names(data, offsets)
        _, one = np.unique(names, axis=0, return_index=True) if len(names) else (None, np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(names[one, 0]), pa.array(names[one, 1]), b.column(0).take(pa.array(one))], ["t1", "t2", "text"])


#: A context or a part of one (key, ctx), whose windows are those from `off` on of the context (okey, octx). These two are
#: null where all of those windows are known to be repeated, so that nothing more has to be said of them.
_PART = ("key", "ctx", "okey", "octx", "off", "t1", "t2", "s", "n")
_PARTS = pa.schema([(c, pa.int64()) for c in _PART])
_BODIES = pa.schema([*((c, pa.int64()) for c in ("key", "okey", "octx", "off", "n")), ("body", pa.binary())])
_MARKS = pa.schema([(c, pa.int64()) for c in ("key", "ctx", "a", "b")])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long'}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _each(words: bool):
    """(bytes of a text or of its codes, its wanted places) of a batch's rows."""

    def run(b):
        for text, places in zip(b.column("text"), b.column("places")):
            whole = text.as_buffer().to_pybytes()
            if words:
                whole = _coded(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))[0].tobytes()
            yield whole, places.as_py()

    return run


def _bodies(length: int, words: bool):
    """The bytes of each wanted context, out of its text, in small batches, as contexts overlap. Codes are written
    with their highest byte first, so that their bytes have their order."""
    unit, each = CODE if words else 1, _each(words)

    def run(batches):
        for b in batches:
            out, size = [], 0
            for whole, places in each(b):
                if words:
                    whole = np.frombuffer(whole, "<u4").astype(">u4").tobytes()
                for x in places:
                    out.append((x["key"], x["okey"], x["octx"], x["off"], x["n"], whole[unit * x["s"] : unit * (x["s"] + x["n"] // LEADS + length - 1)]))
                    size += len(out[-1][-1])
                    if size > 4 << 20:
                        yield _batch(out, _BODIES)
                        out, size = [], 0
            yield _batch(out, _BODIES)

    return run


def dealt(x: dict, whole: bytes, cell: int, length: int, unit: int = 1) -> list[tuple]:
    """A context x of a text in parts, as _PART, by cells of starts before its anchor: each under the hash of its
    cell's core, the bytes that all windows of the cell have in common."""
    n, lead = x["n"] // LEADS, x["n"] % LEADS
    body = whole[unit * x["s"] : unit * (x["s"] + n + length - 1)]
    out = []
    at = 0
    # a start's place before the anchor falls from lead to lead - n + 1; cells are cut by it
    while at < n:
        c = (lead - at) // cell
        to = min(n, lead - c * cell + 1)
        core = body[unit * max(0, lead - c * cell) : unit * (lead - (c * cell + cell - 1) + length)]
        part = body[unit * at : unit * (to + length - 1)]
        key = xxhash.xxh3_64_intdigest(core, c % (1 << 32)) >> 1
        ctx = xxhash.xxh3_64_intdigest(part, at - lead & 0xFFFFFFFF) >> 1
        out.append((key, ctx, x["okey"], x["octx"], x["off"] + at, x["t1"], x["t2"], x["s"] + at, (to - at) * LEADS + lead - at))
        at = to
    return out


def _deal(length: int, words: bool, cell: int):
    unit, each = CODE if words else 1, _each(words)

    def run(batches):
        for b in batches:
            out = []
            for whole, places in each(b):
                for x in places:
                    out += dealt(x, whole, cell, length, unit)
                    if len(out) > 10_000:
                        yield _batch(out, _PARTS)
                        out = []
            yield _batch(out, _PARTS)

    return run


def _sorted_marks(length: int, words: bool, most: int = 1 << 20):
    """Of bodies in the order of their keys: runs [a, b) of repeated windows of each original context, found by suffix
    arrays over about `most` bytes of whole keys."""

    def flush(rows: list):
        out = []
        groups = np.cumsum([0, *(a[0] != b[0] for a, b in zip(rows, rows[1:]))]).tolist()
        for row, at in zip(rows, repeated_places([r[5] for r in rows], [r[4] // LEADS for r in rows], length, groups, CODE if words else 1)):
            if len(at) and row[1] is not None:
                cut = np.flatnonzero(np.diff(at) > 1)
                out += [(row[1], row[2], row[3] + int(x), row[3] + int(y) + 1) for x, y in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])]
        return _batch(out, _MARKS)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(f.name).to_pylist() for f in _BODIES)):
                if size > most and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        yield flush(rows)

    return run


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(by_words: bool):
    """The output columns of each document, from its text and its repeated spans, of which those in words are removed
    only `by_words`."""

    def passages(data, spans):
        coded = _merged((x["a"], x["b"]) for x in spans if x["words"])
        if not coded:
            return 0, []
        starts, ends = word_edges(np.frombuffer(data, np.uint8))
        return sum(b - a for a, b in coded), [(int(starts[a]), int(ends[b - 1])) for a, b in coded]

    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.int64())
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed", "n_passage_words"]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b, rows = whole.slice(i, 512), []
                for text, spans in zip(b.column("text"), b.column("spans")):
                    data, found = text.as_buffer().to_pybytes() if text.is_valid else b"", spans.as_py() or ()
                    words, in_words = passages(data, found)
                    gone = _merged([*((x["a"], x["b"]) for x in found if not x["words"]), *(in_words if by_words else ())])
                    edges = [0, *(e for g in gone for e in g), len(data)]
                    kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"a": x, "b": y} for x, y in gone], words))
                yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    return run


def _named(batches):
    for b in batches:
        names = _names(*utf8(b.column("text")))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[:, 0]), pa.array(names[:, 1])], [*b.schema.names, "t1", "t2"])


def _ruled(parts: DataFrame) -> DataFrame:
    """One row for each key and context of a key that occurs more than once: how often the context occurs (c), how
    many contexts the key has (kinds), and one of its places. All counts are map-side aggregates, and the totals are stored,
    so that adaptive execution splits the join with them: no key's occurrences or contexts meet in one task."""
    one = [F.when(F.count(F.lit(1)) == 1, F.first(x)).alias(x) for x in ("okey", "octx") if x in parts.columns]
    kinds = parts.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("c"), *one, *(F.first(x).alias(x) for x in _PART[4:] if x in parts.columns))
    totals = kinds.groupBy("key").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1").select("key", "kinds")
    totals = stored(totals, "totals")
    if not one:
        kinds = kinds.select("*", *(F.when(F.col("c") == 1, F.col(x)).alias(f"o{x}") for x in ("key", "ctx")), F.lit(0).cast("long").alias("off"))
    return stored(kinds.join(totals, "key").select(*_PART, "c", "kinds"), "ruled")


def _spans(text: DataFrame, length: int, gram: int, key_cap: int, words: bool) -> DataFrame:
    """(t1, t2, spans): the repeated spans of each text that has any, in bytes of the text or in words; stored."""
    every = stored(text.mapInArrow(_occurrences(length, gram, words), _OCC), "occurrences")
    # most keys of a corpus occur once: they go before anything else is done
    repeated = stored(every.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("key"), "keys")
    occ = stored(every.join(repeated, "key", "left_semi"), "repeated")
    dropped(every, repeated)
    whole = text.mapInArrow(_texts, "t1 long, t2 long, text string")

    def with_texts(places):
        # a text's wanted places are bounded by its length
        wanted = places.groupBy("t1", "t2").agg(F.collect_list(F.struct(*_PART)).alias("places"))
        return whole.join(wanted, ["t1", "t2"]).select("text", "places")

    ruled = _ruled(occ)
    kept = [occ, ruled]
    rules = [ruled.where("c > 1").select("key", "ctx", F.lit(0).cast("long").alias("a"), F.expr(f"n div {LEADS}").alias("b"))]
    sortable = [ruled.where(f"kinds between 2 and {key_cap}")]
    for cell in CELLS:
        over = ruled.where(f"kinds > {key_cap}")
        if over.isEmpty():
            break
        parts = stored(with_texts(over).mapInArrow(_deal(length, words, cell), _sql(_PARTS)), "parts")
        ruled = _ruled(parts)
        kept += [parts, ruled]
        rules.append(parts.where("okey is not null").join(ruled.where("c > 1").select("key", "ctx"), ["key", "ctx"]).select(F.col("okey").alias("key"), F.col("octx").alias("ctx"), F.col("off").alias("a"), F.expr(f"off + n div {LEADS}").alias("b")))
        sortable.append(ruled.where(f"kinds between 2 and {key_cap}"))
    bodies = with_texts(reduce(DataFrame.unionByName, sortable)).mapInArrow(_bodies(length, words), _sql(_BODIES))
    met = bodies.repartition("key").sortWithinPartitions("key")
    rules.append(met.mapInArrow(_sorted_marks(length, words), _sql(_MARKS)))
    marked = occ.join(reduce(DataFrame.unionByName, rules), ["key", "ctx"])
    x = F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + (length - 1)).alias("b"), F.lit(words).alias("words"))
    spans = stored(marked.groupBy("t1", "t2").agg(F.collect_set(x).alias("spans")), "spans")
    dropped(*kept)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key_cap: int = KEY_CAP, words: int | None = None, by_words: bool = True) -> DataFrame:
    """One row per row of docs: row (its columns, as a struct), n_bytes, n_removed, n_spans, kept_sha256,
    kept (remaining bytes), removed (maximal runs [a, b) of removed bytes) and n_passage_words.

    Matches lie within one text and are judged on the input. A null text is empty; texts shorter than
    `length` lose nothing; repeated rows count as repeats of each other; an empty table gives no rows.
    With `words`, strings of that many consecutive words that repeat are found too, whatever their length in bytes:
    n_passage_words counts their words (0 without `words`), and they are removed as well unless `by_words` is false.
    Columns of docs pass through inside `row` whatever their names.
    """
    small_batches(docs.sparkSession)
    schema = docs.schema
    text = docs.select(F.col("text").cast("string").alias("text"))
    spans = _spans(text, length, gram, key_cap, False)
    if words:
        both = spans.unionByName(_spans(text, words, 1 << min(WORD_GRAM, words).bit_length() - 1, key_cap, True))
        spans = both.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).select("row", F.col("row.text").cast("string").alias("text"))
    kind = "row " + schema.simpleString()
    named = rows.mapInArrow(_named, kind + ", text string, t1 long, t2 long")
    return named.join(spans, ["t1", "t2"], "left").select("row", "text", "spans").mapInArrow(_cut(by_words), kind + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<a:long,b:long>>, n_passage_words long")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key_cap: int = KEY_CAP, words: int | None = None) -> DataFrame:
    """docs with the repeated strings taken out of text, and n_chars, if there is one, counted again. A
    character of which bytes were removed goes as a whole; texts that lose nothing, null among them, stay as
    they are; a text that is all repeats becomes empty."""
    found = remove_repeats(docs, length, gram, key_cap, words).select("row", "n_removed", "kept")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.decode("utf-8", "ignore") for x in b.column(2).to_pylist()], pa.string())], ["row", "n_removed", "kept"])

    texts = found.mapInArrow(run, "row " + docs.schema.simpleString() + ", n_removed long, kept string")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return texts.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in ("text", "n_chars") else F.col("row").getField(c).alias(c) for c in docs.columns))
