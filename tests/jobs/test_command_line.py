import os
import subprocess
import sys
from pathlib import Path

from jobs import dependency_report, refresh_search_index

ROOT = Path(__file__).resolve().parents[2]


def command(*args):
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_MASTER": "local[2]", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stderr


def test_refresh_search_index_twice(spark, tmp_path):
    folder = tmp_path / "documents"
    paths = [x for name in ("documents", "output", "checkpoint") for x in (f"--{name}", f"file://{tmp_path}/{name}")]
    spark.createDataFrame([(1, "one two two", "en", "a")], "doc_id bigint, text string, lang string, source string").write.parquet(str(folder))
    said = command("jobs.refresh_search_index", *paths, "--config", "jobs/refresh_search_index.json")
    assert "read 1 rows" in said and "wrote 2 postings of 1 files" in said
    assert "read 0 rows" in command("jobs.refresh_search_index", *paths, "--config", f"file://{ROOT}/jobs/refresh_search_index.json")
    assert [(r.file_id, r.status) for r in refresh_search_index.current_files(spark, f"{tmp_path}/output").collect()] == [("a:main:1", "created")]


def test_dependency_report(spark, sf_dir, tmp_path):
    said = command("jobs.dependency_report", "--tables", f"file://{sf_dir}", "--output", f"file://{tmp_path}/report", "--config", "jobs/dependency_report.json")
    assert "25 files" in said and dependency_report.read_files(spark, f"{tmp_path}/report").count() == 25
