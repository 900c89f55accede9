import os
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.operators import store
from chronolith.plans.catalog import AT, HOUR
from chronolith.sources import day_tables, log_source, maintenance
from chronolith.sources.driver_view import log
from chronolith.sources.maintenance import Tables
from tests.test_log_source import MAGIC, record, segment


def snapshot_of(path):
    return {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in path.rglob("*") if p.is_file() and "_staged" not in p.parts and not p.name.startswith((".", "_"))}


@pytest.fixture
def tables(spark, sf_dir, tmp_path):
    rows = log(spark, sf_dir)
    t = Tables(*(str(tmp_path / n) for n in ("log", "snapshots", "spans", "assets")))
    day_tables.append_log(rows, t.log)
    for at in (AT - 30 * HOUR, AT + HOUR):
        day_tables.write_snapshots(rows.filter(F.col("t") <= at).limit(20).select(F.to_date(F.timestamp_micros(F.lit(at))).alias("day"), F.lit(at).alias("at"), "monitor_id", "tile_x", "tile_y", "asset_hash"), t.snapshots)
    spans = rows.groupBy("day", "window_id").agg(F.floor(F.min("t") / 1000).cast("long").alias("start_t"), F.floor(F.max("t") / 1000).cast("long").alias("end_t"))
    spans.write.partitionBy("day").parquet(t.spans)
    named = rows.filter("asset_hash <> 0").select("asset_hash").distinct()
    named.union(spark.createDataFrame([(-5,)], "asset_hash long")).repartition(4, "asset_hash").write.parquet(t.assets)
    return t


def test_purge_rewrites_the_touched_days_alone(spark, sf_dir, tables, tmp_path):
    rows, (start, end) = log(spark, sf_dir), (AT - 3 * HOUR, AT + 3 * HOUR)
    before = snapshot_of(tmp_path / "log")
    done = tables.purge(spark, start, end, now_ms=int(time.time() * 1000) + 10_000_000)
    back, want = spark.read.parquet(tables.log), store.purge(rows, start, end)
    assert back.count() == want.count() and want.exceptAll(back.select(want.columns)).isEmpty()
    assert dict(done["log"]) == {r.day: r["count"] for r in rows.filter(F.col("t").between(start, end)).groupBy("day").count().collect()}
    after = snapshot_of(tmp_path / "log")
    days = {f"day={d}" for d, _ in done["log"]}
    assert len(days) == 2 and {p: x for p, x in before.items() if p.parent.name not in days} == {p: x for p, x in after.items() if p.parent.name not in days}
    assert done["snapshots"] == [AT + HOUR] and [r["at"] for r in day_tables.snapshot_times(spark, tables.snapshots).collect()] == [AT - 30 * HOUR]
    spans = spark.read.parquet(tables.spans)
    assert spans.filter((F.col("start_t") < end // 1000) & (F.col("end_t") > start // 1000)).isEmpty() and spans.count() > 0
    left = {r.asset_hash for r in spark.read.parquet(tables.assets).collect()}
    assert left == {r.asset_hash for r in tables.named(spark).collect()} and -5 not in left and done["assets"] >= 1
    assert tables.purge(spark, start, end, now_ms=int(time.time() * 1000))["log"] == []


def test_a_day_that_loses_all_goes(spark, tables):
    days = maintenance.Folder(spark, tables.log).days()
    first = min(days)
    start = int((first - date(1970, 1, 1)).total_seconds()) * 1_000_000
    assert [d for d, _ in maintenance.purge_log(spark, tables.log, start, start + 24 * HOUR - 1)] == [first]
    assert set(maintenance.Folder(spark, tables.log).days()) == set(days) - {first}


def test_prune_drops_whole_days(spark, tables, tmp_path):
    before, days = snapshot_of(tmp_path / "log"), sorted(maintenance.Folder(spark, tables.log).days())
    done = tables.prune(spark, days[-1], 5, now_ms=0)
    assert done["log"] == [d for d in days if d < days[-1] - timedelta(days=5)] and done["assets"] == 0  # all files are young at time 0
    after = snapshot_of(tmp_path / "log")
    assert after == {p: x for p, x in before.items() if p.parent.name[4:] >= str(days[-1] - timedelta(days=5))} and after
    assert maintenance.prune_days(spark, tables.log, days[-1], 0) == [d for d in days[-6:] if d < days[-1] - timedelta(days=1)]


def test_young_files_keep_their_assets(spark, tables):
    assert maintenance.reclaim(spark, tables.assets, spark.createDataFrame([(1,)], "h long"), int(time.time() * 1000), 3_600_000) == 0
    assert spark.read.parquet(tables.assets).filter("asset_hash = -5").count() == 1


def test_a_change_that_was_cut_off_loses_nothing(spark, sf_dir, tables, tmp_path, monkeypatch):
    rows, (start, end) = log(spark, sf_dir), (AT - 3 * HOUR, AT + 3 * HOUR)
    monkeypatch.setattr(maintenance.Folder, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        maintenance.purge_log(spark, tables.log, start, end)
    assert spark.read.parquet(tables.log).count() == rows.count() and maintenance.recover(spark, tables.log) == (0, 1)
    monkeypatch.undo()
    moved, real = [], maintenance.Folder.move

    def dies(self, source, target):
        if not target.endswith(".json") and "/old/" not in target and moved:
            raise OSError("killed")
        moved.extend([target] if "=" in target.split("/")[-1] else [])
        real(self, source, target)

    monkeypatch.setattr(maintenance.Folder, "move", dies)
    with pytest.raises(OSError, match="killed"):
        maintenance.purge_log(spark, tables.log, start, end)
    monkeypatch.undo()
    assert len(moved) == 1 and maintenance.recover(spark, tables.log) == (1, 0)
    want, back = store.purge(rows, start, end), spark.read.parquet(tables.log)
    assert back.count() == want.count() and want.exceptAll(back.select(want.columns)).isEmpty() and not list((tmp_path / "log" / "_staged").iterdir())


def test_segments_are_purged_in_place(spark, tmp_path):
    for day in (1, 2, 3):
        segment(tmp_path / f"2024-01-0{day}", "log.bin", *(record(day * 100 + n) for n in range(50)), tail=b"torn")
    before = {p: p.read_bytes() for p in tmp_path.rglob("*.bin")}
    got = maintenance.purge_segments(spark, str(tmp_path), MAGIC, 140, 219)
    assert [(p.split("/")[-2], n) for p, n in got] == [("2024-01-01", 10), ("2024-01-02", 20)]
    assert sorted(r.t for r in log_source.scan(spark, str(tmp_path), MAGIC).collect()) == [*range(100, 140), *range(220, 250), *range(300, 350)]
    third = tmp_path / "2024-01-03" / "log.bin"
    assert third.read_bytes() == before[third] and (tmp_path / "2024-01-01" / "log.bin").read_bytes() == before[tmp_path / "2024-01-01" / "log.bin"][: 32 + 27 * 40]
    assert maintenance.purge_segments(spark, str(tmp_path), MAGIC, 140, 219) == []


def test_sweeps_choose_by_metadata(spark, tmp_path):
    now = int(time.time() * 1000)
    for n in range(12):
        (tmp_path / "2024-01-01").mkdir(exist_ok=True)
        (tmp_path / "2024-01-01" / f"{1000 + n}-0.raw").write_bytes(bytes(4096))
    for name, age in (("a.tmp", 7200), ("b.tmp", 60), ("c.bin", 7200)):
        (tmp_path / name).write_bytes(b"xyz")
        os.utime(tmp_path / name, (now / 1000 - age,) * 2)
    assert maintenance.sweep(spark, str(tmp_path), "*.tmp", now) == (1, 3)
    assert sorted(p.name for p in tmp_path.glob("?.*")) == ["b.tmp", "c.bin"]
    assert maintenance.trim_dumps(spark, str(tmp_path), 8, 16 * 1024) == (8, 8 * 4096)
    assert sorted(p.name for p in tmp_path.rglob("*.raw")) == [f"{1000 + n}-0.raw" for n in range(8, 12)]
    assert maintenance.trim_dumps(spark, str(tmp_path), 8, 1) == (3, 3 * 4096)
    assert [p.name for p in tmp_path.rglob("*.raw")] == ["1011-0.raw"]
    plan = maintenance.files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
