"""Cost-balanced packing of documents into training sequences.

Documents are taken in blocks of about `block_tokens` tokens, block by block within each partition,
so that nothing is shuffled and a block's memory is bounded. A block of T tokens has T // capacity
sequences of full capacity, and what remains is laid out in sequences whose sizes are the powers of
two that make up the remainder, so that no sequence needs padding. Documents (their pieces of at most
one capacity) are assigned in descending order, each to the sequence of lowest attention cost

    cost = linear * tokens + quadratic * sum(piece length ** 2)

among those with room for it, found by a tree over rooms; where no sequence has room for the whole, the piece
is cut and fills the cheapest sequences that still have room.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches
from .tokens import default_vocabulary, encoder

_NONE = (float("inf"), -1, 0)
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Full sequences, then the powers of two that make up the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


class _Rooms:
    """Sequences by the room they have left: a heap of (cost, sequence) for each room, and a tree over
    rooms that gives the cheapest sequence among those with at least a given room."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.n)]
        self.tree = [_NONE] * (2 * self.n)

    def _refresh(self, room: int) -> None:
        i = room + self.n
        self.tree[i] = self.heaps[room][0] if self.heaps[room] else _NONE
        while i > 1:
            i //= 2
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, room: int, cost: float, seq: int) -> None:
        heapq.heappush(self.heaps[room], (cost, seq, room))
        self._refresh(room)

    def take(self, least: int) -> tuple | None:
        """The cheapest sequence with room for `least`, taken out."""
        best, low, high = _NONE, least + self.n, 2 * self.n
        while low < high:
            if low & 1:
                best = min(best, self.tree[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, self.tree[high])
            low, high = low // 2, high // 2
        if best is _NONE:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._refresh(best[2])
        return best


def assign(lengths: list[int], capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int, float]]:
    """(document, start, length, sequence, offset, cost of the piece) of one block; every sequence is filled."""
    sizes = sequence_sizes(sum(lengths), capacity)
    rooms = _Rooms(capacity)
    for i, size in enumerate(sizes):
        rooms.put(size, 0.0, i)
    pieces = [(min(capacity, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, capacity)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    out = []
    for n, doc, start in pieces:
        while n:
            cost, seq, room = rooms.take(n) or rooms.take(1)
            part = min(n, room)
            added = linear * part + quadratic * part * part
            out.append((doc, start, part, seq, sizes[seq] - room, added))
            if room > part:
                rooms.put(room - part, cost + added, seq)
            start, n = start + part, n - part
    return out


def _blocks(batches, path: str, most: int):
    """Documents' ids by blocks of at least `most` tokens."""
    enc = encoder(path)
    ids, docs, total = [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            docs.append(doc)
            ids.append(enc.ids(text.as_py()))
            total += len(ids[-1])
            if total >= most:
                yield docs, ids
                ids, docs, total = [], [], 0
    if docs:
        yield docs, ids


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    A document is its ids and a final id 0; a null or empty text is that id alone. A null doc_id stays
    null; repeated rows are packed each for itself; other columns are ignored; an empty table gives no
    rows. A document longer than a block is one block. Sequence ids hold the partition in the upper bits
    and are not consecutive.
    """
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches):
        seq = TaskContext.get().partitionId() << 36
        for names, ids in _blocks(batches, path, block_tokens):
            rows = assign([len(x) for x in ids], capacity, linear, quadratic)
            doc, start, n, at, offset, cost = (list(x) for x in zip(*rows))
            crc = [zlib.crc32(ids[d][s : s + k].astype("<u4").tobytes()) for d, s, k in zip(doc, start, n)]
            arrays = [[names[d] for d in doc], start, n, crc, [len(ids[d]) for d in doc], [seq + s for s in at], offset]
            yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int64()) for a in arrays), pa.array(cost, pa.float64())], _NAMES)
            seq += max(at) + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)
