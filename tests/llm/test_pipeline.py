import random

from pyspark.sql import functions as F

import corpus_pipeline

from .helpers import text


def test_stages_over_planted_cases(spark, tmp_path):
    r = random.Random(6)
    item = text(r, 14)
    shared = text(r, 150)
    docs, labels = [], []
    for i in range(400):
        words = text(r, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["scoundrel", "nitwit"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(1001, docs[1][1]), (1002, docs[2][1] + " end"), (2001, text(r, 50) + " " + shared), (2002, shared + " " + text(r, 50)), (3001, text(r, 30) + " " + item + " " + text(r, 30))]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = {}
    df = spark.read.parquet(f"{d}/documents.parquet")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, d).cache()
        kept[name] = df
        if name != "packing":
            assert df.columns == columns
    ids = {n: {r.doc_id for r in x.collect()} for n, x in kept.items()}
    assert not ids["toxicity"] & {i for i in range(0, 400, 4)} and ids["toxicity"] >= {i for i in range(400) if i % 4}
    assert not ids["simhash_near_dedup"] & {1001, 1002} and {1, 2} <= ids["simhash_near_dedup"]
    texts = {r.doc_id: r for r in kept["suffix_array_dedup"].collect()}
    for i in (2001, 2002):
        assert shared not in texts[i].text and len(texts[i].text) == texts[i].n_chars < 800
    assert texts[5].text == dict(docs)[5]
    assert 3001 in ids["suffix_array_dedup"] and 3001 not in ids["decontamination"]
    assert ids["packing"] == ids["decontamination"]
    whole = corpus_pipeline.run(spark, d)
    # how documents are cut depends on the partitions, what they hold does not
    tokens = lambda x: sorted((r.doc_id, r.n) for r in x.groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert tokens(whole) == tokens(kept["packing"]) and set(whole.columns) == set(kept["packing"].columns)


def test_empty_corpus(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
