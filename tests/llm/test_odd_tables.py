"""All operators and stages on tables with nulls in every column, long and empty texts, repeated rows, extra columns
whose names clash with the operators' own, and on empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentrylake.llm import queries

from .helpers import text

CLASHING = ["fp", "key", "row", "removed", "_gone", "_bad", "component_id", "score", "n_words", "rid", "h", "y", "at", "t1", "spans", "place"]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
QUERY_TABLES = {"op1": "documents", "op2": "pages", "op3": "documents", "op5": "documents", "op7": "pages", "op8": "documents", "op9": "documents", "op10": "documents", "op12": "documents"}


def rows():
    r = random.Random(8)
    long = text(r, 60_000)
    docs = [(i, text(r, r.randint(1, 80)), "en", "s", 5) for i in range(1, 60)]
    docs += [(100, None, None, None, None), (None, "no id here", "en", None, 1), (None, None, None, None, None), (101, "", "en", "s", 0), (102, " \t\n", "en", "s", 3), (103, long, "en", "s", None), (104, long, "de", None, 7)]
    docs += docs[:3] + [docs[0][:1] + ("another text under the same id",) + docs[0][2:]]
    return {
        "documents": docs,
        "benchmark": [(1, docs[5][1]), (1, docs[5][1]), (2, None), (None, "x y"), (3, ""), (None, None), (4, "one")],
        "labels": [(i, None if i % 9 == 0 else i % 2, None if i % 7 == 0 else int(i % 5 == 0)) for i in range(1, 60)] + [(None, 1, 1), (3, 1, 1), (999, 0, 0), (100, 1, 0)],
        "pages": [(1, "http://a.example/1", "<p>x</p>" * 40), (2, "http://a.example/2", "<p>x</p>" * 40), (3, None, None), (None, "http://b.example", "<p>y"), (4, "", ""), (5, "no url", "<div><p>a" * 3000), (1, "http://a.example/1", "<p>x</p>" * 40), (None, None, None)],
        "conversations": [(i % 9 or None, i % 7 or None, ("user", "assistant", None, "")[i % 4], ("Yes.", None, "", "No", long)[i % 5]) for i in range(60)] + [(1, 1, "user", "Yes.")] * 3,
        "embeddings": [(i, [float(r.gauss(0, 1)) for _ in range(8)], 1) for i in range(45)]
        + [(60, None, None), (None, [1.0] * 8, 1), (61, [None] + [1.0] * 7, 1), (62, [0.0] * 8, 1), (63, [float("nan")] * 8, 1), (64, [float("inf")] + [0.0] * 7, 1), (65, [], 1), (66, [1.0, 2.0], 1), (20, [1.0] * 8, 2)],
    }


def written(spark, folder, data, extra=()):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(data.get(name, []), schema)
        for i, c in enumerate(extra):
            df = df.withColumn(c, F.lit(None).cast("string") if i % 2 else F.lit(i))
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("odd")), rows(), CLASHING)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("none")), {})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    got = queries.QUERIES[name](spark, odd)
    out = got.collect()
    data = rows()
    table = QUERY_TABLES.get(name.split("_")[0])
    key = got.columns[0]
    order = lambda ids: sorted(ids, key=lambda x: (x is None, x))
    ids = [d[0] for d in data[table]] if table else None
    if name.startswith("op5"):
        assert {r[key] for r in out} == set(ids)
        assert sum(r.doc_tokens for r in out if r.start == 0) == sum(r.length for r in out)
    elif name.startswith("op4"):
        docs = [i for r in out for i, s in zip(r.doc_ids, r.starts) if s == 0]
        assert order(docs) == order([d[0] for d in data["documents"]])
    elif name.startswith("op6"):
        valid = {*range(45), 66}  # 66 is a shorter vector, with zeros for what it lacks
        assert {r.query_id for r in out} == {0, 20, 40} and {r.vec_id for r in out} <= valid
    elif name.startswith("op11"):
        assert all(len(r.word) >= 7 and r.n >= 2 and r.root for r in out) and len({r.word for r in out}) == len(out)
    elif name.startswith("op13"):
        assert order(r[key] for r in out) == order({r[0] for r in data["conversations"]})
    else:
        assert order(r[key] for r in out) == order(ids)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, none, name):
    assert queries.QUERIES[name](spark, none).collect() == []


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, odd).count() > 0
