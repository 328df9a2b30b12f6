import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sentrylake.llm import bfd_packing as bp
from sentrylake.llm import cost_packing as cp
from sentrylake.llm.tokens import default_vocabulary, encoder

from .helpers import text


def docs():
    r = random.Random(8)
    rows = [(i, text(r, r.choice([0, 1, 5, 60, 400, 3000]))) for i in range(60)]
    return rows + [(60, None), (61, ""), (3, rows[3][1]), (None, "no id"), (62, "a<|endoftext|>b\u0000 é 東京 🎉\n\n  x"), (63, "a" * 3000)]


def slow_ids(t):
    return Tokenizer.from_file(default_vocabulary()).encode(t or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_file():
    enc = encoder(default_vocabulary())
    for _, t in docs():
        assert enc.ids(t).tolist() == slow_ids(t)


def test_rooms_and_costs():
    r = random.Random(1)
    for cap in (8, 64, 1024):
        lengths = [r.randint(1, 3 * cap) for _ in range(200)]
        seqs = {}
        for d, s, n, q, o, _ in cp.assign(lengths, cap):
            seqs.setdefault(q, []).append((o, n, d, s))
        for parts in seqs.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
            total = parts[-1][0] + parts[-1][1]
            assert total == cap or (total < cap and total & (total - 1) == 0)
        pieces = {}
        for d, s, n, *_ in cp.assign(lengths, cap):
            pieces.setdefault(d, []).append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, k in sorted(pieces[d]):
                assert s == at
                at += k
            assert at == n


def test_cost_goes_to_the_cheapest_sequence():
    out = cp.assign([4, 4, 2, 2, 2, 2], 8)
    cost = {}
    for _, _, n, q, _, c in out:
        cost[q] = cost.get(q, 0) + c
    assert max(cost.values()) - min(cost.values()) < 0.05


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_pieces_make_up_the_documents(spark, block):
    rows = docs()
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    out = cp.pack(df, 128, block_tokens=block).collect()
    want = sorted((str(d), len(slow_ids(t))) for d, t in rows)
    assert sum(r.length for r in out) == sum(n for _, n in want)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, slow_ids(t))
    for r in out:
        if r.doc_id not in (3, None):
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 128
    assert cp.pack(df.limit(0)).count() == 0


def test_room_tree_finds_the_best_fit():
    r = random.Random(0)
    tree, rooms = bp.RoomTree(50), []
    for i in range(500):
        if rooms and r.random() < 0.5:
            need = r.randint(1, 50)
            best = min((x for x in rooms if x >= need), default=None)
            got = tree.best(need)
            assert (got and got[0]) == best
            if best is not None:
                rooms.remove(best)
        else:
            room = r.randint(1, 50)
            rooms.append(room)
            tree.put(room, i)


def test_best_fit_decreasing_equals_the_plain_search():
    r = random.Random(3)
    lengths = [r.randint(1, 150) for _ in range(300)]
    rows = bp.best_fit(lengths, 64)
    rest = sorted((n % 64 for n in lengths if n % 64), reverse=True)
    rooms = []
    for n in rest:
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(64 - n)
    assert len(rows) == sum(n // 64 for n in lengths) + len(rooms)
    assert sum(n for row in rows for _, _, n in row) == sum(lengths)


def test_matrices_round_trip(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(docs())]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_tokens int").repartition(3)
    packed = bp.pack_matrices(df, 128, block_tokens=3000)
    parts = {}
    for r in packed.collect():
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(pos) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, []).append((s, ids[a:b].tolist()))
    for d, t in rows:
        assert [i for _, p in sorted(parts[d]) for i in p] == slow_ids(t)
    folder = f"{tmp_path}/matrices"
    n = sum(r.sequences for r in bp.write_matrices(packed, folder).collect())
    back = bp.read_matrices(spark, folder, 128).collect()
    assert n == len(back) == packed.count()
    key = lambda cu, ids: (tuple(cu), tuple(ids))
    assert sorted(key(r.cu_seqlens, r.ids) for r in back) == sorted(key(r.cu_seqlens, np.frombuffer(r.input_ids, "<u2").tolist()) for r in packed.collect())
    assert bp.pack_matrices(df.limit(0)).count() == 0
