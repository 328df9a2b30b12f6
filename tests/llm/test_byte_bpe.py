import hashlib
import random

import numpy as np
import pytest

from sentrylake.llm import byte_bpe, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(byte_bpe.default_ranks())


def brute(codec, docs):
    out = []
    for doc, text in docs:
        ids = np.array(codec.engine.encode_ordinary(text or ""), "<u4")
        out.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(encoded):
    out = byte_bpe.digests(byte_bpe.decode(encoded))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_table_equals_the_library(spark, codec):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_byte_bpe(spark, SF).collect()), key=str) == brute(codec, docs)


PARTS = ["word ", "don't", "we'll've", "  ", "   x", "\n\n \t", "12345", "١٢٣", "é", "東京都", "ܐܒ", "!?", "''s", "'", "'r", "e ", " ", "　 ", "🙂🙂", "a" * 90, " " * 90, "'" * 70, "x'ſ", "\U00011de0", "՘", "࢏", "<|endoftext|>"]


def made(seed, n):
    pick = random.Random(seed)
    return [(pick.choice([None, i, 3]), "".join(pick.choice(PARTS) for _ in range(pick.choice((0, 1, 5, 40, 300))))) for i in range(n)] + [(5, None), (6, ""), (7, "a" * 5000), (8, " " * 5000 + "b" + "'s" * 900), (9, "12 " * 3000)]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (97, 40), (7, 5), (1000, 3)])
def test_any_chunks_equal_the_library(spark, codec, chunk, overlap):
    docs = made(chunk, 250)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as rid", "2 as part").repartition(4)
    encoded = byte_bpe.encode(df, chunk=chunk, overlap=overlap)
    assert got(encoded) == brute(codec, docs)
    if chunk < 100:
        assert encoded.where("part > 0").count() > 500


def test_boundaries_are_those_of_the_engine(codec):
    """Every character by itself and between others: pre-tokens encoded one by one give the ids of the whole."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(every), 60_000):
        text = "".join(f"{c}a {c}" for c in every[i : i + 60_000])
        at = [*codec.boundaries(text), len(text)]
        parts = [x for s, e in zip(at, at[1:]) for x in codec.engine._encode_single_piece(text[s:e])]
        assert parts == codec.engine.encode_ordinary(text)


def test_runs_longer_than_the_matcher_takes(codec):
    for text in (" " * 2_000_000 + "x", "a\n" + "\n" * 1_500_000, "q" * 300_000):
        assert codec.decode(codec.encode(text)) == text.encode()
    n = byte_bpe.SPACES
    for text in ("y" + " " * n + "x z", " " * (n + 5), "\t" * n + "'s"):
        assert codec.encode(text).tolist() == codec.engine.encode_ordinary(text)


def test_empty_table(spark):
    assert got(byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"))) == []
