import pytest

from jobs import dependency_report as job
from jobs.registered import ORACLE_SQL, QUERIES


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def tables(spark, tmp_path):
    """Two repositories of three files, with one call of a supplier that is not there."""
    put = lambda name, data, schema: spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    put("region", [(0, "R"), (1, "S")], "r_regionkey int, r_name string")
    put("nation", [(0, "N O", 0), (1, "P", 0), (2, "Q", 1)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, "c1", 0), (2, "c2", 2), (3, None, 2)], "c_custkey bigint, c_name string, c_nationkey int")
    put("supplier", [(1, "Supplier#000000001", 1), (2, "Supplier#000000002", 2)], "s_suppkey bigint, s_name string, s_nationkey int")
    put("orders", [(10, 1, "2020-01-01"), (11, 1, "2020-02-01"), (12, 2, None), (13, None, "2020-03-01")], "o_orderkey bigint, o_custkey bigint, o_orderdate string")
    put("lineitem", [(10, 1, 1), (11, 1, 1), (11, 1, 2), (11, 2, 3), (12, 1, 1), (12, 9, 2), (13, 1, 1), (None, 1, 1)], "l_orderkey bigint, l_suppkey bigint, l_linenumber int")
    return str(tmp_path)


def test_report(spark, tables, tmp_path):
    report = job.run(spark, tables, str(tmp_path / "out"))
    assert report["call_sites"] == 6 and report["files"] == 3
    pairs = {(r.file_id, r.called_file_id): (r.repo, r.called_repo, r.calls, r.call_sites, r.confidence) for r in job.read_coupling(spark, str(tmp_path / "out")).collect()}
    assert pairs == {
        ("R:main:n_o.py", "R:main:p.py"): ("R", "R", 1, 3, 0.95),
        ("R:main:n_o.py", "S:main:q.py"): ("R", "S", 1, 1, 0.95),
        ("S:main:q.py", "R:main:p.py"): ("S", "R", 1, 1, 0.95),
        ("S:main:q.py", None): ("S", None, 1, 1, 0.5),
    }
    files = {r.file_id: (r.classes, r.resources, r.calls_out, r.calls_in, r.files_called, r.files_calling, r.calls_unresolved) for r in job.read_files(spark, str(tmp_path / "out")).collect()}
    assert files == {"R:main:n_o.py": (1, 0, 2, 0, 2, 0, 0), "R:main:p.py": (0, 1, 0, 2, 0, 2, 0), "S:main:q.py": (2, 1, 2, 1, 1, 1, 1)}


def test_running_again_and_running_a_part(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    job.run(spark, tables, out)
    before = rows(job.read_files(spark, out)), rows(job.read_coupling(spark, out))
    job.run(spark, tables, out)
    job.run(spark, tables, out, {"repositories": ["S"]})
    assert (rows(job.read_files(spark, out)), rows(job.read_coupling(spark, out))) == before
    part = str(tmp_path / "part")
    job.run(spark, tables, part, {"repositories": ["S"]})
    assert {r.repo for r in job.read_files(spark, part).collect()} == {"S"}
    whole = [r for r in job.read_files(spark, out).collect() if r.repo == "S"]
    assert [r.calls_in for r in job.read_files(spark, part).collect()] == [r.calls_in for r in whole], "calls by others count"


def test_empty_tables(spark, tables, tmp_path):
    spark.createDataFrame([], "l_orderkey bigint, l_suppkey bigint, l_linenumber int").write.mode("overwrite").parquet(f"{tables}/lineitem.parquet")
    report = job.run(spark, tables, str(tmp_path / "out"))
    assert (report["call_sites"], report["coupling"], report["files"]) == (0, 0, 3)
    spark.createDataFrame([], "n_nationkey int, n_name string, n_regionkey int").write.mode("overwrite").parquet(f"{tables}/nation.parquet")
    assert job.run(spark, tables, str(tmp_path / "none"))["files"] == 0


def test_query_matches_sql(against_sql):
    against_sql(QUERIES["job2_dependency_report"], ORACLE_SQL["job2_dependency_report"])


def test_call_sites_are_gone_through_once(spark):
    sites = spark.createDataFrame([("a", "m:x", "CALLS", 0.9, 1, 1), ("a", "m:x", "CALLS", 0.5, 3, 3), ("a", "m:y", "CALLS", 0.7, 2, 2)], "source_id string, target_id string, rel_type string, confidence double, seen int, place int")
    merged = job.merged_calls(sites)
    assert sorted(map(tuple, merged.collect())) == [("a", "m:x", "CALLS", 0.5, 3, 2), ("a", "m:y", "CALLS", 0.7, 2, 1)]
    assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()
