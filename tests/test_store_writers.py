import struct

import pytest
from pyspark.sql import functions as F

from chronolith.operators import store
from chronolith.sources import binary_store, staging, store_files

PACK = "asset_hash long, codec int, width int, height int, payload binary"


def assets(spark, hashes, size=300):
    return spark.createDataFrame([(h, 1, 4, 4, bytearray(bytes([h % 251]) * (size + h % 7))) for h in hashes], PACK)


def read(spark, path):
    index = binary_store.read_pack_index(spark, path, b"REC1")
    return {r.asset_hash: bytes(r.payload) for r in binary_store.read_assets(spark, path, index).collect()}, index


def test_snapshots_come_back(spark, tmp_path):
    rows = [(t, m, 64, -1920 + m, -100, 1920, 1080, 30, 18, [0, 5, m, 9], [7, -6, t, 0]) for t in (70, 1_700_000_000_000_000) for m in (1, 2)]
    shots = spark.createDataFrame(rows, store_files.SnapshotFiles.columns)
    for _ in range(2):  # the second time each file replaces itself
        store_files.write_snapshots(shots.repartition(3), str(tmp_path), b"POINT1")
    back = binary_store.read_checkpoints(spark, str(tmp_path), b"POINT1")
    want = [(*r[:9], r[9][:3], r[10][:3]) for r in rows]
    assert sorted(tuple(r) for r in back.drop("path").collect()) == sorted(want)
    assert sorted(p.name for p in tmp_path.rglob("*.ckpt")) == ["1700000000000000.ckpt", "70.ckpt"]
    assert (tmp_path / "2023-11-14" / "checkpoints" / "1700000000000000.ckpt").exists()


def test_packs_keep_one_copy_and_roll(spark, tmp_path):
    path = str(tmp_path)
    store_files.write_packs(assets(spark, [*range(1, 41), 5, 5, -9]).coalesce(1), path, b"REC1", b"HEAD1", roll_bytes=4000)
    got, index = read(spark, path)
    assert got.keys() == {*range(1, 41), -9} and got[5] == bytes([5]) * 305
    sizes = [p.stat().st_size for p in tmp_path.glob("*.pack")]
    assert len(sizes) > 2 and max(sizes) < 4000 + 24 + 310
    before = {p.name: p.read_bytes() for p in tmp_path.glob("*.*")}
    store_files.write_packs(assets(spark, range(30, 60)), path, b"REC1", b"HEAD1")
    got, index = read(spark, path)
    assert got.keys() == {*range(1, 60), -9} and index.count() == 60
    assert {n: (tmp_path / n).read_bytes() for n in before} == before
    head = (tmp_path / "000000.pack").read_bytes()[:24]
    h, n = struct.unpack("<qI", head[12:])
    assert head[:6] == b"HEAD1\x01" and len(got[h]) == n
    some = index.filter("asset_hash in (3, 44, -9)")
    assert {r.asset_hash: bytes(r.payload) for r in store_files.fetch(some, path).collect()} == {h: got[h] for h in (3, 44, -9)}


def test_a_task_that_dies_leaves_no_pack(spark, tmp_path):
    bad = assets(spark, range(1, 50)).repartition(3).withColumn("codec", F.when(F.col("asset_hash") == 40, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("codec")))
    with pytest.raises(Exception, match="lost"):
        store_files.write_packs(bad, str(tmp_path), b"REC1", b"HEAD1", roll_bytes=500)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_bytes_without_an_index_are_not_stored(spark, tmp_path, monkeypatch):
    moved, finish = [], staging._finish
    real = staging.fs.LocalFileSystem

    class Dies:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def move(self, a, b):
            if b.endswith(".idx"):
                raise OSError("killed")
            moved.append(b)
            self.system.move(a, b)

    assert isinstance(staging.opened(str(tmp_path))[0], real)
    writer = store_files.Packs({"path": str(tmp_path), "magic": "REC1", "otherMagic": "HEAD1"})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"asset_hash": 8, "codec": 1, "width": 4, "height": 4, "payload": b"abc"}])
    message = writer.write(iter([batch]))
    monkeypatch.setattr(staging, "_finish", lambda system, folder: finish(Dies(system), folder))
    with pytest.raises(OSError, match="killed"):
        writer.commit([message])
    assert [m.rsplit("/")[-1] for m in moved] == ["000000.pack"] and not list(tmp_path.glob("*.idx"))
    monkeypatch.undo()
    assert staging.recover(str(tmp_path)) == (1, 0) and read(spark, str(tmp_path))[0] == {8: b"abc"}
    (tmp_path / "000001.pack").write_bytes(b"left behind")
    store_files.write_packs(assets(spark, [9]), str(tmp_path), b"REC1", b"HEAD1")
    assert [p.rsplit("/")[-1] for p in store_files.recover_packs(spark, str(tmp_path), b"REC1")] == ["000001.pack"]
    assert read(spark, str(tmp_path))[0].keys() == {8, 9}


def test_manifests_and_frames(spark, tmp_path):
    rows = [(f"2024-01-0{d}", h) for d in (1, 2) for h in (3, -4, 0, 3, 3 + d)]
    named = spark.createDataFrame(rows, "day string, asset_hash long").withColumn("day", F.to_date("day"))
    store_files.write_manifest(named, str(tmp_path / "m"), b"MANIF1")
    store_files.write_manifest(named.filter("asset_hash = 4"), str(tmp_path / "m"), b"MANIF1")
    back = binary_store.read_manifest(spark, str(tmp_path / "m"), b"MANIF1")
    assert sorted((r.path.split("/")[-2][-1], r.asset_hash) for r in back.collect()) == [("1", -4), ("1", 3), ("1", 4), ("1", 4), ("2", -4), ("2", 3), ("2", 5)]
    frames = spark.createDataFrame([(42, 1, -10, 0, 2, 3, bytearray(range(24))), (43, 2, 0, 0, 1, 1, bytearray(b"abcd+"))], store_files.FrameFiles.columns)
    store_files.write_frames(frames, str(tmp_path / "f"), b"FRAME")
    got = sorted((r.t, r.monitor_id, r.x, r.width, bytes(r.bgra)) for r in binary_store.read_frames(spark, str(tmp_path / "f"), b"FRAME").collect())
    assert got == [(42, 1, -10, 2, bytes(range(24))), (43, 2, 0, 1, b"abcd")]
    with pytest.raises(Exception, match="4 bytes"):
        store_files.write_frames(frames.withColumn("width", F.lit(9)).withColumn("bgra", F.substring("bgra", 1, 4)), str(tmp_path / "f"), b"FRAME")
    assert store.unseen(named, named, "asset_hash").isEmpty()


def test_packs_of_garbage_are_removed(spark, tmp_path):
    path = str(tmp_path)
    for hashes in ((1, 2), (3,), (4, 5), (6,)):
        store_files.write_packs(assets(spark, hashes).coalesce(1), path, b"REC1", b"HEAD1")
    gone = spark.createDataFrame([(1,), (3,), (4,), (5,), (6,)], "asset_hash long")
    assert store_files.reclaim_packs(spark, path, b"REC1", gone) == [1, 2]
    assert read(spark, path)[0].keys() == {1, 2, 6} and sorted(p.name for p in tmp_path.glob("*.*")) == ["000000.idx", "000000.pack", "000003.idx", "000003.pack"]


def test_frames_are_exported_as_pictures(spark, tmp_path):
    frames = spark.createDataFrame([(1, 5_000_000, 2, 1, bytearray(b"\x01\x02\x03\x04" * 2)), (2, 5_000_000, None, None, None)], "monitor_id long, instant long, width int, height int, bgra binary")
    store_files.write_pictures(frames, str(tmp_path))
    (one,) = tmp_path.glob("*.png")
    assert one.name == "5000000-1.png" and one.read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"
