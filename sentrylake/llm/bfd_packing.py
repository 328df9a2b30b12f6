"""Best-fit-decreasing packing into token matrices, and their files.

A document longer than the capacity gives full rows of its own, losslessly; what remains of it, and
shorter documents, are placed in descending order into the row with the least sufficient room. A
segment tree over rooms holds how many rows have each room, so that the search takes log2(capacity)
steps. Documents are taken in blocks of about `block_tokens` tokens within each partition: nothing is
shuffled, and no block grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cost_packing import _blocks
from ._shared import small_batches
from .tokens import END, default_vocabulary

_FIELDS = [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())]
_SCHEMA = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class RoomTree:
    """Rows by room: leaf r counts the rows with room r; a node counts those below it."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.n)
        self.rows: list[list[int]] = [[] for _ in range(self.n)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        i = room + self.n
        while i:
            self.count[i] += by
            i //= 2

    def best(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room of at least `need`, taken out."""
        i = need + self.n
        while not self.count[i]:
            while i & 1:  # no right sibling within this parent
                i //= 2
            if i <= 1:
                return None
            i += 1
        while i < self.n:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.n
        row = self.rows[room].pop()
        self._add(room, -1)
        return room, row


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length)."""
    rows: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        full = n // capacity * capacity
        rows += [[(d, s, capacity)] for s in range(0, full, capacity)]
        if n > full:
            rest.append((n - full, d, full))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = RoomTree(capacity)
    for n, d, s in rest:
        found = tree.best(n)
        if found is None:
            rows.append([])
            found = capacity, len(rows) - 1
        room, row = found
        rows[row].append((d, s, n))
        if room > n:
            tree.put(room - n, row)
    return rows


def pack_matrices(docs: DataFrame, capacity: int = 2048, path: str | None = None, block_tokens: int = 1 << 20, id_type: str = "<u2") -> DataFrame:
    """One row per packed sequence: sequence_id, n_tokens, n_segments, doc_ids and starts of its segments,
    cu_seqlens (cumulative lengths from 0), input_ids (capacity ids as id_type, padded with id 0) and
    position_ids (int32, from 0 in each segment and again in the padding).

    The ids of all segments of a document, by start, are the whole document with its final id 0. A null or
    empty text is that id alone; null doc_ids stay null; repeated rows are packed each for itself; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches):
        seq = TaskContext.get().partitionId() << 36
        for names, ids in _blocks(batches, path, block_tokens):
            rows = best_fit([len(x) for x in ids], capacity)
            for i in range(0, len(rows), 256):
                cols: list[list] = [[] for _ in _FIELDS]
                for row in rows[i : i + 256]:
                    matrix, pos, cu = np.full(capacity, END, id_type), np.zeros(capacity, "<i4"), [0]
                    for d, s, n in row:
                        if ids[d].max() > np.iinfo(id_type).max:
                            raise ValueError(f"an id does not fit in {id_type}")
                        matrix[cu[-1] : cu[-1] + n] = ids[d][s : s + n]
                        pos[cu[-1] : cu[-1] + n] = np.arange(n)
                        cu.append(cu[-1] + n)
                    pos[cu[-1] :] = np.arange(capacity - cu[-1])
                    for c, v in zip(cols, (seq, cu[-1], len(row), [names[d] for d, _, _ in row], [s for _, s, _ in row], cu, matrix.tobytes(), pos.tobytes())):
                        c.append(v)
                    seq += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], [n for n, _ in _FIELDS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Writes packed sequences as binary files, a set for each task: NAME.ids (rows of ids), NAME.pos (rows of
    int32 positions), NAME.cu (int32 count and cumulative lengths of each row). Gives the manifest:
    name, sequences. `folder` is a URI that pyarrow's file systems or the local one can write; a task writes
    under a name of its own attempt and renames at its end, so that a retried task leaves one set."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():06d}", 0
        kinds = ("ids", "pos", "cu")
        temp = {k: f"{root}/_{name}-{task.taskAttemptId()}.{k}" for k in kinds}
        files = {k: store.open_output_stream(p) for k, p in temp.items()}
        for b in batches:
            for ids, pos, cu in zip(*(b.column(c).to_pylist() for c in ("input_ids", "position_ids", "cu_seqlens"))):
                files["ids"].write(ids)
                files["pos"].write(pos)
                files["cu"].write(np.array([len(cu), *cu], "<i4").tobytes())
                n += 1
        for k in kinds:
            files[k].close()
            if n:
                store.move(temp[k], f"{root}/{name}.{k}")
            else:
                store.delete_file(temp[k])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "sequences"])

    return packed.mapInArrow(run, "name string, sequences long")


def read_matrices(spark: SparkSession, folder: str, capacity: int, id_type: str = "<u2") -> DataFrame:
    """(name, row, cu_seqlens, ids array<int>) from the files of write_matrices; a file of ids is one task's."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.cu").load(folder).select("path")

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                cu = np.frombuffer(store.open_input_file(at).read(), "<i4")
                with store.open_input_file(at[:-2] + "ids") as f:
                    i = row = 0
                    while i < len(cu):
                        k = int(cu[i])
                        ids = np.frombuffer(f.read(capacity * np.dtype(id_type).itemsize), id_type)
                        yield pa.RecordBatch.from_arrays([pa.array([at.rsplit("/", 1)[-1][:-3]]), pa.array([row], pa.int64()), pa.array([cu[i + 1 : i + 1 + k]], pa.list_(pa.int32())), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["name", "row", "cu_seqlens", "ids"])
                        i, row = i + 1 + k, row + 1

    return names.mapInArrow(run, "name string, row long, cu_seqlens array<int>, ids array<int>")
