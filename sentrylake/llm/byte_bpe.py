"""Byte-level BPE encoding and decoding of texts of any length, by a file of ranks at a path that is a parameter.

Texts of up to one chunk are encoded where they are read. Longer ones are cut into chunks that overlap, which are dealt
out and split into pre-tokens in parallel, each from its own start. A match of the pattern depends on what follows it
only, so that from the first boundary that two neighbours share in their overlap on, both have the same pre-tokens; there
they are stitched, and what lies between two such places is a piece that is encoded by itself. A chunk whose overlap
shows no common boundary (one long run of letters, say) is glued to the one before. Decoding concatenates the bytes of
ids.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, stored

#: Characters of a chunk, without its overlap, and of the overlap.
CHUNK = 1 << 15
OVERLAP = 1 << 9
#: The pattern looks at so many characters at most behind a match that ends, to tell that it ends there.
AHEAD = 2
#: Characters of a run of white space that the engine's matcher takes without running out of its stack.
SPACES = 1 << 14

_kept: dict = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _ranges(chars: str) -> str:
    """A character class of sorted characters, as ranges."""
    points = np.array([ord(c) for c in chars])
    edges = np.flatnonzero(np.diff(points) > 1)
    return "".join(f"\\U{points[i]:08x}-\\U{points[j]:08x}" for i, j in zip([0, *(edges + 1)], [*edges, len(points) - 1]))


class Codec:
    """Ids of texts and texts of ids, as the tiktoken library gives for the ranks at `path` and `pattern`."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.engine = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = pattern
        self.long_space = re.compile(rf"\s{{{SPACES}}}")

    @property
    def splitter(self) -> tuple[re.Pattern, re.Pattern]:
        """The pattern with the engine's own classes of letters and numbers written out, which are those of another version
        of Unicode than other matchers', and a pattern for boundaries that hold whatever stands before."""
        if not hasattr(self, "_splitter"):
            import tiktoken

            every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
            single = {bytes([i]): i for i in range(256)}
            classes = {}
            for kind in (r"\p{L}", r"\p{N}", r"\s"):
                found = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
                classes[kind] = _ranges(found.decode_bytes(found.encode_ordinary(every)).decode())
            letters, numbers, spaces = classes[r"\p{L}"], classes[r"\p{N}"], classes[r"\s"]
            inside = lambda x: x.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", spaces)
            written = re.sub(r"\[\^([^\]]*)\]", lambda m: "[^" + inside(m[1]) + "]", self.pattern)
            written = written.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
            self._splitter = re.compile(written), re.compile(f"[{letters}](?![{letters}])|[{numbers}](?![{numbers}])")
        return self._splitter

    def boundaries(self, text: str, start: int = 0) -> list[int]:
        """Starts of the pre-tokens of a text that is split from `start` on."""
        return [m.start() for m in self.splitter[0].finditer(text, start)]

    def encode(self, text: str) -> np.ndarray:
        if self.long_space.search(text) is None:
            return np.array(self.engine.encode_ordinary(text), np.uint32)
        parts = [self.engine._encode_single_piece(m[0]) for m in self.splitter[0].finditer(text)]
        return np.array([i for p in parts for i in p], np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.engine.decode_bytes(ids.tolist())


def codec(path: str, pattern: str | None = None) -> Codec:
    """One for each Python worker, path and pattern."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if (path, pattern) not in _kept:
        _kept[path, pattern] = Codec(path, pattern)
    return _kept[path, pattern]


def _ids(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _encoder(path: str, pattern: str | None):
    """Rows (doc_id, rid, part, text), each encoded for itself."""

    def run(batches):
        for b in batches:
            made = codec(path, pattern)
            ids = [_ids(made.encode(t.as_py() or "")) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["rid"], b["part"], pa.array(ids, pa.binary())], ["doc_id", "rid", "part", "ids"])

    return run


def _cutter(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for doc, rid, text in zip(b["doc_id"].to_pylist(), b["rid"].to_pylist(), b["text"]):
                text = text.as_py()
                starts = range(0, len(text), chunk)
                for some in itertools.batched(enumerate(starts), 64):
                    cut = [text[s : s + chunk + overlap] for _, s in some]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cut), pa.string()), pa.array([rid] * len(cut), pa.int64()), pa.array([i for i, _ in some], pa.int64()), pa.array(cut, pa.string())], ["doc_id", "rid", "part", "text"])

    return run


def _edges(path: str, pattern: str | None, chunk: int, overlap: int):
    """Of each chunk, the boundaries in the overlap with the one before (`head`, from the chunk's start) and with the next
    (`tail`, likewise from the next one's start), and those of the former that hold whatever stands before (`sure`)."""

    def run(batches):
        for b in batches:
            made, heads, tails, sures = codec(path, pattern), [], [], []
            for part, text in zip(b["part"].to_pylist(), b["text"]):
                text = text.as_py()
                at = made.boundaries(text)
                # behind white space the end of a piece would be split otherwise than the middle of a text
                heads.append([p for p in at if 0 < p < overlap and not text[p - 1].isspace()])
                tails.append([p - chunk for p in at if chunk <= p <= len(text) - AHEAD])
                sures.append([m.end() for m in made.splitter[1].finditer(text, 0, min(overlap, len(text) - 1)) if m.end() < min(overlap, len(text) - 1)])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails, sures)]
            yield pa.RecordBatch.from_arrays([b["rid"], b["part"], *lists], ["rid", "part", "head", "tail", "sure"])

    return run


def _stitcher():
    """(rid, part, first, cut) from edges in order: `cut` is where the piece of a chunk begins, from the chunk's start, and
    `first` the chunk whose piece it is part of. A chunk without a cut belongs to the piece before."""

    def run(batches):
        rid, tail, synced, first = None, [], False, 0
        for b in batches:
            rows = []
            for r, part, head, own_tail, sure in zip(*(b[c].to_pylist() for c in ("rid", "part", "head", "tail", "sure"))):
                if r != rid:
                    rid, cut, synced = r, 0, True
                elif synced:
                    cut = min(set(head) & set(tail), default=None)
                else:
                    cut = min(set(head) & set(sure), default=None)
                tail, synced = own_tail, cut is not None
                first = part if synced else first
                rows.append((r, part, first, cut))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)], ["rid", "part", "first", "cut"])

    return run


def _joiner(chunk: int):
    """Texts of pieces from chunks in order, each with its own cut and that of the piece behind (null at the end)."""

    def run(batches):
        now, parts = None, []
        names = ["doc_id", "rid", "part", "text"]

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([now[2]], pa.int64()), pa.array(["".join(parts)], pa.string())], names)

        for b in batches:
            for doc, rid, part, first, cut, end, text in zip(*(b[c].to_pylist() for c in ("doc_id", "rid", "part", "first", "cut", "end", "text"))):
                if now is not None and now[1:] != (rid, first):
                    yield out()
                    parts = []
                now = (doc, rid, first)
                # the last chunk of a piece goes on to where the next piece begins, others to where the next chunk begins
                parts.append(text[cut or 0 : chunk if end is None else chunk + end if end >= 0 else None])
        if now is not None:
            yield out()

    return run


def pieces(long: DataFrame, path: str, pattern: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, rid, part, text): the texts of long(doc_id, rid, text), cut at boundaries of pre-tokens."""
    cut = long.mapInArrow(_cutter(chunk, overlap), "doc_id string, rid long, part long, text string")
    chunks = stored(cut.repartition(F.col("rid"), F.col("part")), "chunks")
    edges = chunks.select("rid", "part", "text").mapInArrow(_edges(path, pattern, chunk, overlap), "rid long, part long, head array<long>, tail array<long>, sure array<long>")
    cuts = stored(edges.repartition("rid").sortWithinPartitions("rid", "part").mapInArrow(_stitcher(), "rid long, part long, first long, cut long"), "cuts")
    # a chunk's piece ends where the next chunk's begins: a number if that has a cut, null if it has none, -1 if there is none
    following = cuts.select("rid", (F.col("part") - 1).alias("part"), F.col("cut").alias("end"), F.lit(True).alias("more"))
    ends = cuts.join(following, ["rid", "part"], "left").withColumn("end", F.when(F.col("more"), F.col("end")).otherwise(-1)).drop("more")
    whole = chunks.join(ends, ["rid", "part"]).repartition("rid", "first").sortWithinPartitions("rid", "first", "part")
    return whole.select("doc_id", "rid", "part", "first", "cut", "end", "text").mapInArrow(_joiner(chunk), "doc_id string, rid long, part long, text string")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of a text of docs(doc_id, text): doc_id, rid (of a text of several pieces; else null), part (the
    place of the piece, ascending), ids (little-endian unsigned 32-bit numbers, as binary). Pieces of one text stand in order
    in one partition.

    A null or empty text is one piece without ids; a null doc_id stays null; repeated rows are encoded each for itself;
    other columns are ignored; an empty table gives no rows. A run that shows no boundary, of any length, is one piece.
    """
    small_batches(docs.sparkSession)
    path = path or default_ranks()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    schema = "doc_id long, rid long, part long, ids binary"
    short = texts.where(~is_long).select("doc_id", F.lit(None).cast("long").alias("rid"), F.lit(0).cast("long").alias("part"), "text")
    long = stored(texts.where(is_long).withColumn("rid", F.monotonically_increasing_id()), "long")
    cut = pieces(long.select(F.col("doc_id").cast("string").alias("doc_id"), "rid", "text"), path, pattern, chunk, overlap)
    cut = cut.select(F.col("doc_id").cast("long").alias("doc_id"), "rid", "part", "text")
    ordered = cut.mapInArrow(_encoder(path, pattern), schema).repartition("rid").sortWithinPartitions("rid", "part")
    return short.mapInArrow(_encoder(path, pattern), schema).unionByName(ordered)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(doc_id, rid, part, ids) with `bytes`, those of its ids one behind the other."""
    path = path or default_ranks()

    def run(batches):
        for b in batches:
            made = codec(path)
            out = [made.decode(np.frombuffer(x.as_buffer(), "<u4")) for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "bytes"])

    return encoded.select("doc_id", "rid", "part", "ids").mapInArrow(run, "doc_id long, rid long, part long, ids binary, bytes binary")


def _hasher(batches):
    """Digests of texts whose pieces stand behind each other in order."""
    now, out = None, []
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def row():
        return (now[0], now[2], now[3].hexdigest(), now[4].hexdigest())

    def batch(rows):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names)

    for b in batches:
        for doc, rid, ids, data in zip(*(b[c].to_pylist() for c in ("doc_id", "rid", "ids", "bytes"))):
            if now is None or rid is None or now[1] != rid:
                out += [row()] if now is not None else []
                now = [doc, rid, 0, hashlib.sha256(), hashlib.sha256()]
            now[2] += len(ids) // 4
            now[3].update(ids)
            now[4].update(data)
        if len(out) > 1000:
            yield batch(out)
            out = []
    out += [row()] if now is not None else []
    if out:
        yield batch(out)


def digests(decoded: DataFrame) -> DataFrame:
    """One row per text: doc_id, n_tokens, ids_sha256, decoded_sha256, of ids and bytes over all its pieces, which stand in
    order as `encode` leaves them."""
    return decoded.mapInArrow(_hasher, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
