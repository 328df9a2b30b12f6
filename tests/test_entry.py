import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "title", "published"] and df.count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values())) and len(queries) > 200
