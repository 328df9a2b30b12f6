"""Commits, states with racing and failing writers, and a handler that is lost between data and progress."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sentrylake.sources import pages, sinks
from sentrylake.sources.commits import CommitLog
from sentrylake.streaming import handler


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.newest() is None and log.read(1) is None and log.numbers() == []
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: CommitLog(spark, f"{tmp_path}/log").put(7, f"writer {i}"), range(16)))
    assert sum(won) == 1 and log.read(7) == f"writer {won.index(True)}"
    assert log.put(12, "é") and not log.put(12, "x") and log.numbers() == [7, 12] and log.read(12) == "é"
    with pytest.raises(ValueError):
        log.put(-1, "")


def test_failing_and_racing_writers(spark, tmp_path):
    root = f"{tmp_path}/state"
    with pytest.raises(LookupError):
        sinks.read_state(spark, root)
    sinks.write_state(spark.range(3), root, 1)
    bad = spark.range(5).withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        sinks.write_state(bad, root, 2)
    assert sinks.read_state(spark, root).count() == 3
    sinks.write_state(spark.range(5), root, 2)  # the retry
    assert sinks.read_state(spark, root).count() == 5 and sinks.read_state(spark, root, 1).count() == 3

    def racing(n):
        try:
            sinks.write_state(spark.range(n), root, 3)
        except sinks.VersionTaken:
            return None
        return n

    with ThreadPoolExecutor(4) as pool:
        won = [n for n in pool.map(racing, (10, 20, 30, 40)) if n]
    assert len(won) == 1 and sinks.read_state(spark, root).count() == won[0]


def test_report_lines_have_a_byte_cap(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "aé")], "n int, line string")
    sinks.write_lines(lines, ["n"], "line", f"{tmp_path}/r", most_bytes=6)
    (f,) = tmp_path.glob("r/*.txt")
    assert f.read_text() == "aé\nb\n"
    with pytest.raises(ValueError, match="6 bytes"):
        sinks.write_lines(lines, ["n"], "line", f"{tmp_path}/q", most_bytes=5)
    assert not (tmp_path / "q").exists()


SCHEMA = "id long, v string"


def put(root, page, ids):
    folder = root / f"pages/page={page}"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("".join(json.dumps({"id": i, "v": f"v{i}", "more": 1}) + "\n" for i in ids))


def run(spark, root, between=lambda n: None):
    stream = pages.page_stream(spark, f"{root}/pages", SCHEMA)
    stream.writeStream.foreachBatch(handler.source_handler(f"{root}/out", "id", between)).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()


def lost(number):
    raise RuntimeError("lost")


def test_a_run_lost_between_data_and_progress(spark, tmp_path):
    out = f"{tmp_path}/out"
    ids = lambda: sorted(r.id for r in handler.handled(spark, out, SCHEMA).collect())
    put(tmp_path, 0, range(5))
    put(tmp_path, 1, range(5, 8))
    assert ids() == [] and handler.progress_of(spark, out) is None
    run(spark, tmp_path)
    assert ids() == list(range(8)) and handler.progress_of(spark, out) == 7
    put(tmp_path, 2, range(8, 20))
    with pytest.raises(PySparkException):
        run(spark, tmp_path, lost)
    assert ids() == list(range(20)) and handler.progress_of(spark, out) == 7
    folders = len(list((tmp_path / "out/data").iterdir()))
    run(spark, tmp_path)  # the progress comes from the evidence; nothing is written again
    assert ids() == list(range(20)) and handler.progress_of(spark, out) == 19
    assert len(list((tmp_path / "out/data").iterdir())) == folders
    run(spark, tmp_path)
    assert ids() == list(range(20))


def test_evidence_must_agree(spark, tmp_path):
    root = f"{tmp_path}/out"
    step = handler.source_handler(root, "id")
    step(spark.range(4), 0)
    with pytest.raises(handler.EvidenceConflict, match="go back"):
        step(spark.range(2), 1)
    folder = json.loads(CommitLog(spark, f"{root}/data").read(0))["folder"]
    spark.range(9).write.mode("append").parquet(folder)
    with pytest.raises(handler.EvidenceConflict, match="other data"):
        step(spark.range(4), 0)
