import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.sources import binary_log, log_source, staging
from chronolith.sources.driver_view import log

MAGIC = b"SEG!AB"
FIELDS = list(log_source.RECORD.names)


def record(t, x=1, h=5, op=0):
    return struct.pack("<qIHhhqB", t, 7, 1, x, 3, h, op)


def segment(folder, name, *records, tail=b""):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(MAGIC + bytes(26) + b"".join(records) + tail)


def parts(df):
    return df.rdd.getNumPartitions()


def test_ranges_of_one_segment_equal_the_whole(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = np.zeros(50_000, log_source.RECORD)
    for name in FIELDS:
        rows[name] = rng.integers(0, 200, len(rows))
    rows["t"] = np.sort(rng.integers(0, 10**9, len(rows)))
    rows[100:130] = 0
    segment(tmp_path / "2024-01-05", "log.bin", rows.tobytes(), tail=b"torn tail")
    whole = binary_log.read_log(spark, str(tmp_path), MAGIC).select("record_no", *FIELDS)
    split = log_source.scan(spark, str(tmp_path), MAGIC, split_bytes=64_000)
    assert parts(split) == -(-50_000 // (64_000 // 27)) and split.count() == 49_970
    assert whole.exceptAll(split.select("record_no", *FIELDS)).isEmpty() and split.select("record_no", *FIELDS).exceptAll(whole).isEmpty()


def test_a_range_of_time_skips_parts_and_days(spark, tmp_path):
    for day in range(1, 6):
        segment(tmp_path / f"2024-01-0{day}", "log.bin", *(record(day * 1000 + n) for n in range(100)))
    scan = log_source.scan(spark, str(tmp_path), MAGIC, in_order=True, split_bytes=270)
    assert parts(scan) == 50
    some = scan.filter(F.col("t").between(3005, 3024))
    assert parts(some) == 3 and sorted(r.t for r in some.collect()) == list(range(3005, 3025))
    assert parts(scan.filter("day = date'2024-01-04'")) == 10 and parts(scan.filter("day > date'2024-01-04'")) == 20
    assert scan.filter("day > date'2024-01-04'").count() == 100 and scan.filter("t > 5098").count() == 1 and scan.filter("t = 7").count() == 0
    segment(tmp_path / "2024-01-06", "log.bin", record(9000), record(6000), record(9001))
    unsorted = log_source.scan(spark, str(tmp_path), MAGIC)
    assert [r.t for r in unsorted.filter("t between 5099 and 6500").orderBy("t").collect()] == [5099, 6000]


def test_segments_in_order_whatever_the_case(spark, tmp_path):
    segment(tmp_path / "2024-01-02", "log.bin", record(50))
    segment(tmp_path / "2024-01-02", "LOG.0002.BIN", record(30), record(40))
    segment(tmp_path / "2024-01-02", "log.0001.bin", record(30, x=2))
    segment(tmp_path / "2024-01-01", "log.bin", record(60), tail=b"half")
    segment(tmp_path / "2024-01-01", "other.bin", record(1))
    (tmp_path / "2024-01-01" / "log.0001.bin").write_bytes(MAGIC[:3])  # a header that is still being written
    scan = log_source.scan(spark, str(tmp_path), MAGIC)
    assert [(r.day.day, r.segment, r.t) for r in log_source.in_order(scan).collect()] == [(1, 1, 60), (2, 0, 30), (2, 1, 30), (2, 1, 40), (2, 2, 50)]
    assert [(r.t, r.tile_x) for r in log_source.merged(scan.filter("day = date'2024-01-02'")).collect()] == [(30, 2), (30, 1), (40, 1), (50, 1)]
    with pytest.raises(Exception, match="no log segment"):
        log_source.scan(spark, str(tmp_path), b"ELSE").count()
    assert log_source.scan(spark, str(tmp_path / "none"), MAGIC).count() == 0


def test_a_growing_log_is_tailed_once_across_restarts(spark, tmp_path):
    at, out, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    day = at / "2024-01-01"

    def run():
        query = log_source.tail(spark, str(at), MAGIC, split_bytes=54).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(r.t for r in spark.read.parquet(out).collect())

    segment(day, "log.bin", *(record(t) for t in range(1, 6)), tail=record(6)[:20])
    assert run() == [1, 2, 3, 4, 5]
    assert run() == [1, 2, 3, 4, 5]
    with (day / "log.bin").open("ab") as file:
        file.write(record(6)[20:] + record(7) + b"x")
    segment(day, "log.0001.bin", record(8))
    assert run() == [1, 2, 3, 4, 5, 6, 7, 8]
    segment(at / "2024-01-02", "log.bin", record(9), bytes(27), record(10))
    assert run() == list(range(1, 11))


def test_a_running_stream_sees_what_is_appended(spark, tmp_path):
    at, got = tmp_path / "log", []
    segment(at / "2024-01-01", "log.bin", record(1))
    query = log_source.tail(spark, str(at), MAGIC).writeStream.foreachBatch(lambda df, n: got.extend(r.t for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for t in range(2, 5):
            with (at / "2024-01-01" / "log.bin").open("ab") as file:
                file.write(record(t))
            until = time.time() + 60
            while t not in got and time.time() < until:
                time.sleep(0.1)
        assert got == [1, 2, 3, 4]
    finally:
        query.stop()


def test_written_segments_come_back(spark, sf_dir, tmp_path):
    at, rows = str(tmp_path / "log"), log(spark, sf_dir)
    half = F.col("event_id") % 2
    zero = rows.limit(1).select([F.col("day") if c == "day" else F.lit(0).cast(t).alias(c) for c, t in rows.dtypes])
    log_source.write(rows.filter(half == 0).unionByName(zero), at, MAGIC)
    log_source.write(rows.filter(half == 1), at, MAGIC)
    back = log_source.scan(spark, at, MAGIC, in_order=True)
    narrow = [F.col(c).cast(dict(back.dtypes)[c]).alias(c) for c in ("day", *FIELDS)]
    want = rows.select(narrow)
    assert want.exceptAll(back.select("day", *FIELDS)).isEmpty() and back.count() == want.count()
    assert back.select("day", "segment").distinct().groupBy("day").count().filter("count < 2").isEmpty()
    ordered = back.selectExpr("t", "lag(t) over (partition by path order by record_no) as b")
    assert ordered.filter("b > t").isEmpty()
    day = rows.agg(F.min("day")).first()[0]
    first = {p: p.read_bytes() for p in (tmp_path / "log").rglob("*.bin") if p.parent.name != str(day)}
    log_source.write(rows.filter(F.col("day") == F.lit(day)).limit(3), at, MAGIC, overwrite=True)
    assert log_source.scan(spark, at, MAGIC).filter(F.col("day") == F.lit(day)).count() == 3
    assert {p: p.read_bytes() for p in (tmp_path / "log").rglob("*.bin") if p.parent.name != str(day)} == first
    assert not list((tmp_path / "log" / "_staged").iterdir())


def test_a_job_that_dies_leaves_nothing_to_read(spark, tmp_path):
    at = tmp_path / "log"
    rows = spark.range(100).selectExpr("date'2024-01-01' as day", "id as t", "id as event_id", *(f"1L as {c}" for c in FIELDS[1:-1]), "if(id = 90, cast(raise_error('lost') as int), 0) as op")
    with pytest.raises(Exception, match="lost"):
        log_source.write(rows.repartition(3), str(at), MAGIC)
    assert log_source.scan(spark, str(at), MAGIC).count() == 0 and not list(at.rglob("*.bin"))


def test_a_commit_that_was_cut_off_is_ended(tmp_path, monkeypatch):
    root = str(tmp_path)
    stage, lost = staging.Stage(root), staging.Stage(root)
    for s in (stage, lost):
        path, out = s.file()
        with out:
            out.write(b"data")
    (tmp_path / "old").write_bytes(b"old")
    moves = [(p, f"{root}/new/{n}") for n, p in enumerate(sorted(map(str, (tmp_path / "_staged" / stage.job).iterdir())))]
    monkeypatch.setattr(staging, "_finish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        stage.commit(moves, [f"{root}/old"])
    assert (tmp_path / "old").exists() and not (tmp_path / "new").exists()
    monkeypatch.undo()
    assert staging.recover(root) == (1, 1) and staging.recover(root) == (0, 0)
    assert (tmp_path / "new" / "0").read_bytes() == b"data" and not (tmp_path / "old").exists()
