"""The store of series: replaced runs, pruned folders and row groups."""

import pytest
from pyspark.sql import functions as F

from drivescope.sources import tables

SCHEMA = "run_id long, name string, ts_ms long, seq long, value_num double"


@pytest.fixture
def rows():
    return [(r, n, t, r * 1000 + t, None if t % 5 == 0 else float(t)) for r in (1, 2, 3) for n in ("a", "b") for t in range(20)] + [
        (None, "a", 1, 9001, 1.0), (1, None, None, 9002, None), (1, "a", 1, 9003, 1.0)]


@pytest.fixture
def store(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    tables.write_series(spark.createDataFrame(rows, SCHEMA), path)
    return path


def plain(d):
    return sorted(map(str, (tuple(r[c] for c in ("run_id", "name", "ts_ms", "seq", "value_num")) for r in d.collect())))


def test_everything_comes_back_and_a_run_is_replaced(spark, rows, store):
    assert plain(tables.read_series(spark, store)) == sorted(map(str, rows))
    tables.write_series(spark.createDataFrame([(2, "c", 1, 1, 1.0)], SCHEMA), store)
    assert plain(tables.read_series(spark, store)) == sorted(map(str, [r for r in rows if r[0] != 2] + [(2, "c", 1, 1, 1.0)]))
    tables.write_series(spark.createDataFrame([], SCHEMA), store)
    assert tables.read_series(spark, store, runs=[2]).count() == 1


def test_selection_equals_a_filter(spark, rows, store):
    got = tables.read_series(spark, store, ["a"], [1, 3], (5, 9))
    assert plain(got) == sorted(str(r) for r in rows if r[1] == "a" and r[0] in (1, 3) and r[2] is not None and 5 <= r[2] <= 9)
    assert tables.read_series(spark, store, runs=[]).count() == 0 and tables.read_series(spark, store, ["nothing"]).count() == 0


def test_plan_prunes_folders_and_row_groups(spark, store, tmp_path):
    plan = tables.read_series(spark, store, ["a"], [3], (5, 9))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(run_id" in plan.replace("isnotnull(run_id#", "(run_id#") and "EqualTo(name,a)" in plan and "GreaterThanOrEqual(ts_ms,5)" in plan
    wanted = str(tmp_path / "wanted")
    spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "run_id long, tag string").write.parquet(wanted)
    d = tables.read_series(spark, store, ["a"], spark.read.parquet(wanted).where("tag = 'y'"))
    assert "dynamicpruning" in d._jdf.queryExecution().executedPlan().toString()
    assert {r.run_id for r in d.collect()} == {2} and d.count() == 20
    folders = tables.read_series(spark, store, runs=[2]).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("run_id=2" in r.f for r in folders)
