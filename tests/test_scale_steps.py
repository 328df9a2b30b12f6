"""Steps whose cost must not grow faster than the input: files written, and Python objects held at a time."""

import gc
import glob
import weakref

import pyarrow as pa
import pytest

from sentrylake.plans import functions, normalizers, registry
from sentrylake.sources import elements as E


def test_bundles_are_not_a_file_each(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id AS conv_id", "CAST(0 AS INT) AS turn", "'user' AS role", "concat('t ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(functions, "shared_folder", lambda t, name: f"{tmp_path}/shared")
    got = registry.QUERIES["s13_stix_bundle"](spark, str(tmp_path)).groupBy("state").count().collect()
    assert {x["state"] for x in got} == {"depth", "duplicate_key", "string", "constant", "malformed", "shape", "ok"} and sum(x["count"] for x in got) == 300
    files = [f for f in glob.glob(f"{tmp_path}/shared/**/part-*", recursive=True)]
    assert 0 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_elements_of_few_pages_are_objects_at_a_time(monkeypatch):
    class Held(list):
        pass

    live, most = weakref.WeakSet(), [0]

    class Key(Held):
        __hash__ = object.__hash__

    real, made = E.read_elements, []

    def read_elements(page, tags):
        found = real(page, tags)
        if found is None:
            return None
        out = Key(found)
        live.add(out)
        most[0] = max(most[0], len(live))
        return out

    monkeypatch.setattr(E, "read_elements", read_elements)
    monkeypatch.setattr(E.F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda c: c))
    monkeypatch.setattr(E.F, "col", lambda c: c)
    E.elements("html", "a", "nav")
    pages = [None, "", *(f"<nav class='x'><a href='/{i}'>t {i}</a></nav>" for i in range(500)), "<b>" * 600]
    gc.collect()
    got = made[0](pa.array(pages)).to_pylist(maps_as_pydicts="strict")
    assert got == [real(p, frozenset(["a", "nav"])) for p in pages]
    assert most[0] <= 2 * E.PAGES


@pytest.mark.parametrize("name, module", [("s07_feed_guard", functions), ("s10_publication_files", normalizers)])
def test_texts_of_feeds_are_not_a_file_each(spark, tmp_path, monkeypatch, name, module):
    spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source", "'en' AS lang", "CAST(1 AS BIGINT) AS n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(module, "shared_folder", lambda t, name: f"{tmp_path}/shared")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() >= 100
    assert 0 < len(glob.glob(f"{tmp_path}/shared/**/part-*", recursive=True)) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
