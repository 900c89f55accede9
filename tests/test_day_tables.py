from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.operators import state
from chronolith.plans.catalog import AT, HOUR
from chronolith.sources import day_tables
from chronolith.sources.driver_view import log


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = log(spark, sf_dir)
    zero = rows.limit(1).select([F.col("day") if c == "day" else F.lit(0).cast(t).alias(c) for c, t in rows.dtypes])
    day_tables.append_log(rows.unionByName(zero), f"{path}/log")
    return path


def test_the_log_comes_back_without_zero_entries(spark, sf_dir, stored):
    rows = log(spark, sf_dir)
    back = spark.read.parquet(f"{stored}/log").select(rows.columns)
    assert back.count() == rows.count() and rows.exceptAll(back).isEmpty()


def test_a_range_reads_its_days_alone(spark, sf_dir, stored):
    part = day_tables.log_between(spark, f"{stored}/log", AT, AT + 6 * HOUR)
    want = log(spark, sf_dir).filter(F.col("t").between(AT, AT + 6 * HOUR))
    assert sorted(r.event_id for r in part.collect()) == sorted(r.event_id for r in want.collect())
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(t," in plan
    files = {f.split("day=")[1][:10] for f in part.select(F.input_file_name().alias("f")).distinct().toPandas().f}
    assert len(part.inputFiles()) >= len(files) and files <= {"2024-01-14", "2024-01-15", "2024-01-16"}


def test_state_from_the_newest_snapshot(spark, sf_dir, stored):
    path, rows = f"{stored}/snapshots", log(spark, sf_dir)
    for at in (AT - 48 * HOUR, AT - 5 * HOUR, AT - 5 * HOUR, AT + HOUR):  # one is written twice
        cells = state.fold(rows, at).withColumns({"at": F.lit(at), "day": F.to_date(F.timestamp_micros(F.lit(at)))})
        day_tables.write_snapshots(cells, path)
    assert sorted(r["at"] for r in day_tables.snapshot_times(spark, path).collect()) == [AT - 48 * HOUR, AT - 5 * HOUR, AT + HOUR]
    assert day_tables.newest_snapshot(spark, path, AT)[1] == AT - 5 * HOUR
    assert day_tables.newest_snapshot(spark, path, AT - 49 * HOUR) == (None, None)
    for at in (AT, AT - 5 * HOUR, AT - 49 * HOUR):
        got = day_tables.state_at(spark, f"{stored}/log", path, at)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.fold(rows, at).collect()))


def test_assets_are_added_once(spark, stored):
    path = f"{stored}/assets"
    for hashes in ((1, 2, 2), (2, 3), (3,)):
        day_tables.append_assets(spark.createDataFrame([(h, bytearray(b"x")) for h in hashes], "asset_hash long, payload binary"), path)
    assert sorted(r.asset_hash for r in spark.read.parquet(path).collect()) == [1, 2, 3]


@pytest.mark.parametrize("every", [7, 60])
def test_states_at_many_instants_from_snapshots(spark, sf_dir, stored, tmp_path, every):
    rows, path = log(spark, sf_dir), str(tmp_path / "snapshots")
    for at in (AT - 100 * HOUR, AT - 48 * HOUR, AT - 47 * HOUR, AT - 5 * HOUR, AT + 100 * HOUR):
        cells = state.fold(rows, at).withColumns({"at": F.lit(at), "day": F.to_date(F.timestamp_micros(F.lit(at)))})
        day_tables.write_snapshots(cells, path)
    asked = [(m, AT - 60 * HOUR + n * every * HOUR // 7) for n in range(30) for m in (0, 1, 3)] + [(2, AT - 5 * HOUR), (9, AT)]
    points = spark.createDataFrame(asked, "monitor_id long, at long")
    got = day_tables.states_at(spark, f"{stored}/log", path, points)
    want = state.folds(rows, points)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    early = spark.createDataFrame([(0, AT - 300 * HOUR), (1, AT - 90 * HOUR)], "monitor_id long, at long")
    assert sorted(map(tuple, day_tables.states_at(spark, f"{stored}/log", path, early).collect())) == sorted(map(tuple, state.folds(rows, early).collect()))
    scans = [line for line in got._jdf.queryExecution().toString().splitlines() if "FileScan" in line and "event_id" in line]
    first = date(1970, 1, 1) + timedelta(days=(AT - 100 * HOUR) // (24 * HOUR) - 1)
    assert scans and all(f">= {first})" in line for line in scans)
    assert day_tables.states_at(spark, f"{stored}/log", path, points.limit(0)).count() == 0
