"""Queries over pages against their SQL, on titles that the given tables hold seldom."""

import duckdb
import pytest

from sentrylake.plans import registry

from .test_queries import compare

TITLES = ["A &amp; B", "cut &amp", "x &quot;y&quot;", "&amp;lt;b&amp;gt;", "&#65;&nbsp;&eacute;", "a & b &&amp;", "R&D"]


@pytest.mark.parametrize("name", ["s09_page_metadata", "x252_page_metadata"])
def test_titles_keep_references_that_sql_does_not_know(spark, tmp_path, name):
    # six ids of each title, as x252 plants data in five of six pages
    rows = [(6 * i + k, f"https://x.example.org/{i}/{k}", f"<html><head><title>{t}</title></head><body>b &quot;</body></html>") for i, t in enumerate(TITLES) for k in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    compare(duck, registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name])
