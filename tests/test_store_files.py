import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import codec, geo
from chronolith.operators import metrics, render, state, store, timeline
from chronolith.sources import binary_store
from chronolith.streaming import seeded
from tests.test_parts import LOG, entry

GRID = "monitor_id long, columns long, rows long, origin_x long, origin_y long, first_t long, last_t long, row long"


def in_force(geometry, monitor, t):
    rows = [g for g in geometry if g[0] == monitor and g[5] <= t]
    covering = [g for g in rows if t <= g[6]]
    if covering:
        return max(covering, key=lambda g: (g[5], -g[7]))
    return max(rows, key=lambda g: (g[6], g[7])) if rows else None


def plain_replay(log, geometry, at, base=()):
    """The rule entry by entry: canvases of cells by index, emptied when columns or rows change."""
    now, cells = {}, {}
    for m in {g[0] for g in geometry}:
        now[m] = in_force(geometry, m, at) or max((g for g in geometry if g[0] == m), key=lambda g: (g[6], g[7]))
        cells[m] = {i: h for n, c, r, i, h in base if n == m and (c, r) == now[m][1:3]}
    for i, t, _, _, _, m, x, y, h, op in sorted(log, key=lambda r: (r[1], r[0])):
        if op == 4 or t > at or m not in now:
            continue
        g = in_force(geometry, m, t)
        if g:
            if g[1:3] != now[m][1:3]:
                cells[m] = {}
            now[m] = g
        _, columns, rows, ox, oy, *_ = now[m]
        if op <= 2 and 0 <= x - ox < columns and 0 <= y - oy < rows:
            cells[m][(y - oy) * columns + x - ox] = None if op == 2 else h
    return sorted((m, i, h) for m, c in cells.items() for i, h in c.items() if h is not None)


@pytest.mark.parametrize("seed", range(6))
def test_replay_on_changing_grids(spark, seed):
    rnd = random.Random(seed)
    geometry = []
    for row in range(rnd.randrange(1, 6)):
        first = rnd.randrange(0, 80)
        geometry.append((rnd.randrange(2), rnd.choice([2, 4]), rnd.choice([3, 3, 2]), rnd.choice([0, 0, -1]), 0, first, first + rnd.randrange(40), row))
    rows = []
    for i in range(150):
        op = rnd.choice([0, 0, 0, 1, 2, 3, 4])
        m = 0 if op == 3 else rnd.randrange(3)
        rows.append((i, i * 2 // 3, "d", 0, 1, m, rnd.randrange(-1, 5), rnd.randrange(3), rnd.randrange(1, 9), op))
    base = [(m, 4, 3, i, 100 + i) for m in range(2) for i in range(0, 12, 2)]
    frame, dim = spark.createDataFrame(rows, LOG), spark.createDataFrame(geometry, GRID)
    snapshot = spark.createDataFrame(base, "monitor_id long, columns long, rows long, idx long, asset_hash long")
    for at in (10, 95):
        assert sorted(map(tuple, state.replay(frame, dim, at).collect())) == plain_replay(rows, geometry, at)
        assert sorted(map(tuple, state.replay(frame, dim, at, snapshot).collect())) == plain_replay(rows, geometry, at, base)


def test_asof_over_slices_equals_search(spark):
    rnd = random.Random(4)
    left = [(i, rnd.randrange(2), rnd.randrange(300)) for i in range(200)]
    right = [(rnd.randrange(2), rnd.randrange(300), rnd.choice([None, rnd.randrange(99)])) for _ in range(30)]
    got = state.asof(spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, v long"), "t", ["k"], "v", 40)
    want = [(*l, max(((t, v) for k, t, v in right if k == l[1] and t <= l[2] and v is not None), default=(0, None))[1]) for l in left]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_coalescing_over_slices(spark):
    rnd = random.Random(5)
    spans = sorted((s := rnd.randrange(2000), s + rnd.randrange(30)) for _ in range(90))
    islands = []
    for a, b in spans:
        if islands and a - islands[-1][1] <= 10:
            islands[-1] = [islands[-1][0], max(islands[-1][1], b), islands[-1][2] + 1]
        else:
            islands.append([a, b, 1])
    df = spark.createDataFrame([("k", *s) for s in spans], "k string, a long, b long")
    got = sorted((r.start_t, r.end_t, r.n) for r in timeline.coalesced(df, "k", "a", "b", 10, slice_us=100).collect())
    assert got == sorted(map(tuple, islands))


def test_spans_are_upserted(spark):
    schema = "day string, app string, title string, start_ts long, end_ts long"
    old = spark.createDataFrame([("d", "a", "x", 0, 100), ("d", "b", None, 100, 200)], schema)
    new = spark.createDataFrame([("d", "b", "", 2100, 2500), ("d", "a", "x", 2500, 2600), ("d", "a", "x", 4601, 4700), ("e", "a", "x", 1, 2)], schema)
    got = sorted(map(tuple, timeline.upserted(old, new).collect()))
    assert got == [("d", "a", "x", 0, 100), ("d", "a", "x", 2500, 2600), ("d", "a", "x", 4601, 4700), ("d", "b", "", 100, 2500), ("e", "a", "x", 1, 2)]


def checkpoint(t, monitors, version=1):
    data = b"POINT1" + struct.pack("<BBqII", version, 1, t, len(monitors), 0)
    for head, tiles in monitors:
        data += struct.pack("<HHiiIIIII", *head, len(tiles)) + b"".join(struct.pack("<Iq", *x) for x in tiles)
    return data


def test_snapshots_and_manifests(spark, tmp_path):
    data = checkpoint(70, [((1, 64, -1920, -100, 1920, 1080, 30, 18), [(0, 5), (7, -6), (9999, 3)]), ((2, 64, 0, 0, 64, 64, 1, 1), [])])
    (tmp_path / "70.ckpt").write_bytes(data)
    shots = binary_store.read_checkpoints(spark, str(tmp_path), b"POINT1")
    assert [(r.t, r.monitor_id, r.x, r.columns) for r in shots.orderBy("monitor_id").collect()] == [(70, 1, -1920, 30), (70, 2, 0, 1)]
    assert sorted((r.idx, r.asset_hash) for r in binary_store.snapshot_tiles(shots).collect()) == [(0, 5), (7, -6)]
    for bad in (data[:-20], data[:30], b"POINT2" + data[6:], checkpoint(1, [], version=9)):
        (tmp_path / "70.ckpt").write_bytes(bad)
        with pytest.raises(Exception, match="cut short|no snapshot"):
            binary_store.read_checkpoints(spark, str(tmp_path), b"POINT1").collect()
    (tmp_path / "assets.idx").write_bytes(b"MANIF1\x01\x00" + struct.pack("<4q", 3, 0, -4, 3) + b"torn")
    (tmp_path / "assets.1.idx").write_bytes(b"OTHER1\x01\x00" + struct.pack("<q", 8))
    assert sorted(r.asset_hash for r in binary_store.read_manifest(spark, str(tmp_path), b"MANIF1").collect()) == [-4, 3, 3]


def test_geometry_files(spark, tmp_path):
    monitor = {"id": 1, "deviceName": "d", "x": -1920, "y": 0, "width": 1366, "height": 768, "tileSize": 64, "firstSeenUnixMs": 5, "lastSeenUnixMs": 9}
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "meta.json").write_text(json.dumps({"version": 1, "monitors": [monitor, {**monitor, "width": 1024}]}, indent=2))
    (tmp_path / "b" / "meta.json").write_text("{ no json")
    found = binary_store.geometry(binary_store.read_meta(spark, str(tmp_path))).orderBy("row").collect()
    assert [tuple(r) for r in found] == [(1, 22, 12, -30, 0, 5000, 9999, 0), (1, 16, 12, -30, 0, 5000, 9999, 1)]


def test_packs_are_read_to_their_last_good_record(spark, tmp_path):
    tile = np.arange(4 * 4 * 4, dtype=np.uint8).tobytes()
    payloads = [codec.encode(c, 4, 4, tile) for c in (1, 3)]
    key = codec.tile_hash_of(4, 4, tile)
    pack, index = b"", b""
    for n, (c, p) in enumerate(zip((1, 3), payloads)):
        index += struct.pack("<4sqqiBHHBH", b"REC1", key if n else 17, len(pack), 24 + len(p), c, 4, 4, 0, 0)
        pack += bytes(24) + p
    beyond = struct.pack("<4sqqiBHHBH", b"REC1", 99, len(pack), 400, 1, 4, 4, 0, 0)
    (tmp_path / "0.pack").write_bytes(pack)
    (tmp_path / "0.idx").write_bytes(index + beyond + index[:32].replace(struct.pack("<q", 17), struct.pack("<q", 18)) + b"torn")
    (tmp_path / "1.pack").write_bytes(b"nothing points here")
    found = binary_store.read_pack_index(spark, str(tmp_path), b"REC1")
    assert sorted(r.asset_hash for r in found.collect()) == sorted([17, key])
    assets = binary_store.read_assets(spark, str(tmp_path), found)
    assert {bytes(r.bgra) for r in render.decoded(assets).collect()} == {tile}
    assert [r.asset_hash for r in render.decoded(assets, verify=True).collect()] == [key]  # 17 is not its content's hash


def test_frames_are_rendered_and_compared(spark, tmp_path):
    monitors = spark.createDataFrame([(1, -10, 0, 20, 12, 8), (2, 10, 0, 8, 8, 8)], "monitor_id long, x long, y long, width long, height long, tile_size long")
    tile = np.full((8, 8, 4), 200, np.uint8)
    tiles = spark.createDataFrame([(5, 8, 8, bytearray(tile.tobytes()))], "asset_hash long, tile_w int, tile_h int, bgra binary")
    cells = spark.createDataFrame([(1, -2, 0, 5), (1, 0, 1, 5), (1, 1, 0, 77), (1, 1, 1, 0)], "monitor_id long, tile_x long, tile_y long, asset_hash long")
    want = np.zeros((12, 20, 4), np.uint8)
    want[0:8, 0:2] = 200  # cell -2 spans pixels -16..-9 of which -10, -9 are on the monitor
    want[8:12, 10:18] = 200
    frames = render.rendered(cells, tiles, monitors)
    got = {r.monitor_id: r for r in frames.collect()}
    assert bytes(got[1].bgra) == want.tobytes() and set(bytes(got[2].bgra)) == {0}
    truth = want.copy()
    truth[3, 1] = 190
    header = b"FRAME1" + struct.pack("<HiiIII", 1, -10, 0, 20, 12, truth.size)
    (tmp_path / "42-1.raw").write_bytes(header + truth.tobytes())
    read = binary_store.read_frames(spark, str(tmp_path), b"FRAME")
    both = read.select("t", F.col("monitor_id").cast("long").alias("monitor_id"), F.col("bgra").alias("truth")).join(frames, "monitor_id")
    d = render.pixel_diff(both, ("monitor_id", "t"), "truth", "bgra", 3).first()
    assert (d.t, d.mismatches, d.max_delta, d.left, d.top, d.right, d.bottom, d.pixels) == (42, 1, 10, 1, 3, 2, 4, 240)
    same = render.pixel_diff(both, ("monitor_id",), "truth", "bgra", 10).first()
    assert (same.mismatches, same.left) == (0, None)
    image = bytes(frames.filter("monitor_id = 1").select(render.png("width", "height", "bgra").alias("p")).first().p)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and image[16:24] == struct.pack(">II", 20, 12)
    at = image.index(b"IDAT")
    raw = zlib.decompress(image[at + 4 : at + 4 + struct.unpack(">I", image[at - 4 : at])[0]])
    assert len(raw) == 12 * (1 + 80) and raw[1:5] == b"\xc8\xc8\xc8\xff"
    assert tuple(render.desktop(frames, monitors).first()) == (-10, 0, 28, 12, 2)


def test_grid_of_a_monitor(spark):
    c = {k: F.lit(v) for k, v in {"x": -1920, "y": 0, "w": 1366, "h": 768}.items()}
    df = spark.range(1).select(*geo.grid(**c, tile=64), *geo.grid(F.lit(0), F.lit(0), F.lit(1366), F.lit(768), 64), *geo.clipped(F.lit(21), F.lit(0), F.lit(0), F.lit(0), F.lit(1366), F.lit(768), 64))
    assert tuple(df.first()) == (-30, 0, 22, 12, 0, 0, 22, 12, 1344, 0, 22, 64)


def test_readback_plans(spark):
    plan = lambda rects: geo.readback(spark.createDataFrame([(1, *r) for r in rects], "f long, x long, y long, w long, h long"), "f", 640, 480, 0, 0, 64).first().plan
    assert plan([(0, 0, 10, 10), (600, 400, 10, 10)]) == "parts"
    assert plan([(5 * i, 0, 5, 5) for i in range(9)]) == "box"
    assert plan([(60 * i, 50 * i, 5, 5) for i in range(9)]) == "full"
    assert plan([(0, 0, 0, 5)]) == plan([(639, 0, 2, 2)]) == plan([(0, 0, 640, 480)]) == "full"


def test_verdicts_and_short_runs(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    assert tuple(spark.range(1).select(metrics.verdict(t, t), metrics.verdict(t, n), metrics.verdict(n, t), metrics.skipped_percent(F.lit(0), F.lit(0))).first()) == ("PASS", "FAIL", "INVALID", 100.0)
    short = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4)], "k string, seconds double, cpu double, memory double, handles long")
    assert metrics.growth(short, ["k"]).count() == 0


def test_store_keeps_the_newest_pack_and_young_files(spark):
    index = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 4)], "pack long, asset long")
    gone = spark.createDataFrame([(1,), (2,), (4,)], "asset long")
    assert [r.pack for r in store.empty_packs(index, gone).collect()] == [0]
    files = spark.createDataFrame([(1, 0), (2, 900), (3, 0)], "asset long, mtime_ms long")
    assert [r.asset for r in store.old_garbage(files, 1000, 500, gone.filter("asset = 1")).collect()] == [3]
    packed, single = spark.createDataFrame([(1, "p"), (2, "p")], "asset long, place string"), spark.createDataFrame([(2, "f")], "asset long, place string")
    assert sorted(map(tuple, store.stored(packed, single).collect())) == [(1, "p"), (2, "f")]


def test_stream_seeded_from_a_snapshot(spark, tmp_path):
    rnd = random.Random(8)
    rows = [entry(i, i, rnd.randrange(3), 0, rnd.randrange(1, 4), rnd.choice([0, 0, 1, 2, 3])) for i in range(120)]
    spark.conf.set(*seeded.PROVIDER)
    try:
        for n in (1, 2):
            spark.createDataFrame(rows[n * 40 : n * 40 + 40], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        whole = spark.createDataFrame(rows, LOG)
        last = whole.filter("event_id < 40 and op <= 2").groupBy("monitor_id", "tile_x", "tile_y").agg(F.max_by("asset_hash", "t").alias("asset_hash"))
        stream = seeded.changed_since(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), last)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == sorted(r.event_id for r in state.changes(whole).collect() if r.event_id >= 40)
    finally:
        spark.conf.unset(seeded.PROVIDER[0])


def test_snapshots_of_a_stream_equal_the_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows = [entry(i, i * 1_000_000, rnd.randrange(3), 0, rnd.randrange(1, 4), rnd.choice([0, 1, 2, 4])) for i in range(100)]
    batch = spark.createDataFrame(rows, LOG).withColumn("at", F.timestamp_micros("t"))
    for a, b in ((0, 50), (50, 100)):
        batch.filter(f"event_id >= {a} and event_id < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = seeded.snapshots(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "10 seconds", "0 seconds")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("step", F.floor(F.unix_micros("step_end") / 10_000_000) - 1).select("step", "monitor_id", "tile_x", "tile_y", "op", "asset_hash")
    want = state.deltas(batch, 10_000_000).filter("step < 9")
    assert sorted(map(tuple, got.filter("step < 9").collect())) == sorted(map(tuple, want.collect()))
