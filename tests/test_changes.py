import random
import time

import pytest

from codeloom.operators.incremental import classify
from codeloom.streaming.changes import STATUSES, classify_stream, keyed_state

SCHEMA = "file_id string, content_hash string, version int"


@pytest.fixture
def stream(spark, tmp_path):
    def take(rows, keep_ms=None):
        """One more data file, and what a stream that is started again on the same checkpoint says of it."""
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        before = spark.read.schema(STATUSES).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
        with keyed_state(spark):
            started = classify_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "landing")), keep_ms).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        started.awaitTermination()
        now = sorted(map(tuple, spark.read.schema(STATUSES).parquet(str(tmp_path / "out")).collect()), key=repr)
        for r in before:
            now.remove(tuple(r))
        return now

    return take


def test_stream_and_batch_agree_over_restarts(spark, stream):
    rng, stored = random.Random(5), {}
    for version in range(4):
        rows = [(f"f{i}", rng.choice(["a", "b", None]), version) for i in range(12) if rng.random() < 0.6]
        table = spark.createDataFrame([r[:2] for r in rows], "file_id string, content_hash string")
        want = {r.file_id: r.status for r in classify(table, spark.createDataFrame(list(stored.items()), "file_id string, content_hash string")).collect()}
        assert {r[0]: r[3] for r in stream(rows)} == want
        stored |= {f: h for f, h, _ in rows}


def test_several_versions_and_odd_rows_in_a_batch(stream):
    assert stream([("a", "x", 1), ("a", "y", 2), ("a", "z", 0), (None, "x", 1), ("b", None, 1), ("c", "x", None), ("c", "x", None)]) == [("a", "y", "2", "created"), ("b", None, "1", "created"), ("c", "x", "", "created")]
    assert stream([("a", "y", 3), ("b", None, 2), ("c", "y", None)]) == [("a", "y", "3", "up_to_date"), ("b", None, "2", "refreshed"), ("c", "y", "", "refreshed")]


def test_files_are_forgotten(stream):
    assert stream([("a", "x", 1)], keep_ms=1000)[0][3] == "created"
    time.sleep(2)
    assert stream([("a", "x", 2)], keep_ms=1000)[0][3] == "created"


def test_intermediate_tables_are_deleted_on_demand(spark):
    from codeloom.sources import shared

    table = shared.written(spark.range(3), "numbers")
    path = shared._written[-1]
    assert table.count() == 3
    shared.discard_written(spark)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    shared.discard_written(spark)


def test_files_share_a_state(spark, tmp_path):
    for run in (1, 2):
        spark.createDataFrame([(f"f{i}", "x" if i % 3 else f"x{run}", run) for i in range(40 * run)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        with keyed_state(spark):
            started = classify_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "landing")), groups=2).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        started.awaitTermination()
        assert sum(op["numRowsTotal"] for op in started.lastProgress["stateOperators"]) == 2
    got = {(r.file_id, r.version): r.status for r in spark.read.schema(STATUSES).parquet(str(tmp_path / "out")).collect()}
    assert got == {(f"f{i}", str(run)): "created" if run == 1 or i >= 40 else "up_to_date" if i % 3 else "refreshed" for run in (1, 2) for i in range(40 * run)}
