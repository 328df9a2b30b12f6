"""Acceptance and extraction of indicators over a table of customers made here."""

from sentrylake.plans import registry


def people(spark, path, n):
    spark.range(1, n + 1).selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "'M' AS c_mktsegment", "id % 25 AS c_nationkey", "1.0D AS c_acctbal").coalesce(1).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_every_person_is_judged_in_every_kind(spark, tmp_path):
    out = registry.QUERIES["x234_acceptance"](spark, people(spark, tmp_path, 260)).toPandas()
    assert len(out) == 260 * 15 and set(out["kind"]) == {"url", "ipv4", "domain", "file_hash"}
    first = out[out["kind"] == "ipv4"]["value"].str.split(".").str[0].astype(int)
    # multicast and reserved addresses are no indicators, however they are written
    assert not out["accepted"][first.index[first >= 224]].any()
    assert out["accepted"][first.index[first < 224]].any()


def test_texts_of_one_small_file_are_searched_in_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from sentrylake.functions import ioc

    rows = spark.read.parquet(people(spark, tmp_path, 400) + "/customer.parquet")
    assert rows.rdd.getNumPartitions() == 1
    texts = rows.select(F.col("c_custkey").alias("id"), F.lit("Report").alias("title"), F.concat(F.lit("domain bad"), "c_custkey", F.lit(".co")).alias("summary"))
    tasks = []
    matches = ioc._matcher
    try:
        # the task in which each text is searched, told by a column beside the matches
        ioc._matcher = lambda: (lambda t, s: matches()(t, F.concat(s, F.lit(" host p"), F.spark_partition_id().cast("string"), F.lit(".net"))))
        tasks = [x.value for x in ioc.extract(texts).select("value").where("value LIKE 'p%.net'").distinct().collect()]
    finally:
        ioc._matcher = matches
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
