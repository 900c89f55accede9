import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import codec, geo, text
from chronolith.operators import state, store, timeline
from chronolith.sources import binary_log
from chronolith.streaming import changes

LOG = "event_id long, t long, day string, segment int, window_id long, monitor_id long, tile_x long, tile_y long, asset_hash long, op int"


def entry(i, t, x=0, y=0, h=1, op=0, segment=0):
    return (i, t, "d", segment, 1, 0, x, y, h, op)


def test_segments_are_read_with_torn_tail_and_negative_cells(spark, tmp_path):
    record = lambda t, x, h, op=0: struct.pack("<qIHhhqB", t, 7, 1, x, 3, h, op)
    data = b"SEG!" + bytes(28) + record(10, -30, -5) + bytes(27) + record(20, 4, 9, 4) + b"torn"
    (tmp_path / "log.bin").write_bytes(data)
    (tmp_path / "log.0001.bin").write_bytes(b"SEG!" + bytes(28) + record(15, 1, 2))
    rows = binary_log.merged(binary_log.read_log(spark, str(tmp_path), b"SEG!"))
    assert [(r.t, r.tile_x, r.asset_hash, r.op) for r in rows.collect()] == [(10, -30, -5, 0), (15, 1, 2, 0), (20, 4, 9, 4)]
    assert [r.t for r in binary_log.between(rows, 15, 20).collect()] == [15, 20]
    assert [(r.x, r.hot_x, r.visible) for r in binary_log.pointers(rows).collect()] == [(4, 7, True)]
    with pytest.raises(Exception, match="no log segment"):
        binary_log.read_log(spark, str(tmp_path), b"ELSE").count()


def test_five_event_day_has_one_idle_span(spark):
    rows = [entry(i, t * 100_000, h=h) for i, (t, h) in enumerate([(0, 1), (1, 1), (2, 2), (52, 2), (53, 1)])]
    df = spark.createDataFrame(rows, LOG)
    assert [(r.start_t, r.end_t) for r in timeline.idle_spans(df).collect()] == [(200_000, 5_200_000)]


def test_gap_rules(spark):
    beat = lambda s: [entry(i, 1_000_000 * t, op=3) for i, t in enumerate(s)]
    run = lambda rows, **k: [(r.start_t // 1_000_000, r.end_t // 1_000_000, r.reason) for r in timeline.gaps(spark.createDataFrame(rows, LOG), **k).collect()]
    assert run(beat([15, 30, 130, 250])) == [(130, 250, timeline.STOPPED)]
    plain = [entry(i, 1_000_000 * t) for i, t in enumerate([1, 241, 661])]
    assert run(plain) == [(241, 661, timeline.SILENT)]
    inside = spark.createDataFrame([("d", 300_000_000)], "day string, ts long")
    assert run(plain, checkpoints=inside) == []
    assert run(plain, checkpoints=spark.createDataFrame([("d", 241_000_000)], "day string, ts long")) == [(241, 661, timeline.SILENT)]
    assert run([entry(0, 1_000_000), entry(1, 500_000_000, segment=1)])[0][2] == timeline.RESTARTED
    # a restart is proof: neither the longer threshold nor a checkpoint inside hides it
    again = [entry(0, 1_000_000), entry(1, 141_000_000, segment=1)]
    assert run(again, checkpoints=spark.createDataFrame([("d", 60_000_000)], "day string, ts long")) == [(1, 141, timeline.RESTARTED)]


def test_fold_with_base_equals_fold_of_all(spark):
    rnd = random.Random(1)
    rows = [entry(i, 10 + i // 2, rnd.randrange(-3, 3), rnd.randrange(3), rnd.randrange(1, 9), rnd.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, LOG)
    whole = sorted(map(tuple, state.fold(df, 150).collect()))
    assert whole == sorted(map(tuple, state.fold(df.repartition(5), 150, state.fold(df, 90), 90).collect()))
    cells = {}
    for r in rows:
        if r[9] <= 2 and r[1] <= 150:
            cells[r[5], r[6], r[7]] = None if r[9] == 2 else r[8]
    assert whole == sorted((*c, h) for c, h in cells.items() if h is not None)


def test_purge_leaves_nothing_in_range_and_frees_its_assets(spark):
    df = spark.createDataFrame([entry(i, i, h=i) for i in range(1, 10)], LOG)
    left = store.purge(df, 3, 6)
    assert left.filter("t between 3 and 6").count() == 0
    assets = df.select(F.col("asset_hash").alias("asset"))
    assert sorted(r.asset for r in store.garbage(assets, left.select(F.col("asset_hash").alias("asset"))).collect()) == [3, 4, 5, 6]


def test_codecs_round_trip():
    rng = np.random.default_rng(3)
    for tile in (rng.integers(0, 256, (9, 7, 4), dtype=np.uint8), np.full((64, 64, 4), 9, np.uint8), np.cumsum(rng.integers(0, 3, (16, 16, 4)), axis=1).astype(np.uint8)):
        h, w, _ = tile.shape
        for kind in (1, 3):
            assert codec.decode(kind, codec.encode(kind, w, h, tile.tobytes())) == (w, h, tile.tobytes())
        assert codec.decode(2, codec.encode(2, w, h, tile.tobytes()))[2] == codec.rgb565(tile.tobytes())
    assert codec.window_id_of("", "") == 0 and codec.window_id_of("App", "x") == codec.window_id_of("app", "x")
    assert codec.blend(np.array([255]), np.array([0]), np.array([128]))[0] == 128


def test_grid_and_text(spark):
    df = spark.createDataFrame([(-1, -1920, "a.EXE", "My Bank - pay")], "x long, y long, p string, t string")
    cx, cy = geo.unpack(geo.pack(geo.cell(F.col("x"), 64), geo.cell(F.col("y"), 64)))
    r = df.select(cx.alias("cx"), cy.alias("cy"), text.excluded(F.col("p"), F.col("t"), ["a"], []).alias("e"), text.excluded(F.col("p"), F.col("t"), ["b*"], ["/b.nk/", "[("]).alias("g"), text.instant(F.lit("01:02:03.5"), F.lit(0)).alias("i"), text.instant(F.lit("+90"), F.lit(5)).alias("j"), text.instant(F.lit("90"), F.lit(5)).alias("k")).first()
    assert tuple(r) == (-1, -30, True, True, 3_723_500_000, 90_000_005, None)


def test_display_texts(spark):
    df = spark.createDataFrame([(None, None, None), (-1, "  ", False), (1_234_567, " a ", True)], "n long, s string, b boolean")
    rows = df.select(text.count(F.col("n")), text.duration(F.col("n")), text.shown(F.col("s")), text.yes_no(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("—", "—", "—", "—"), ("-1", "—", "—", "no"), ("1,234,567", "1.2s", "a", "yes")]
    more = spark.range(1).select(text.speed(F.lit(2.0)), text.speed(F.lit(1.50)), text.speed(F.lit(0.05)), text.size(F.lit(1536)), text.size(F.lit(20 << 20)), text.size(F.lit(3 << 30)), text.day_long(F.lit("2024-01-05")), text.day_long(F.lit("x")), text.progress(F.lit(5), F.lit(0), F.lit(0)), text.progress(F.lit(9), F.lit(0), F.lit(6)))
    assert tuple(more.first()) == ("2x", "1.5x", "0.05x", "1.5 KB", "20 MB", "3.00 GB", "Fri 5 Jan 2024", "x", 0.0, 1.0)


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [entry(i, i, rnd.randrange(3), 0, rnd.randrange(1, 4), rnd.choice([0, 0, 1, 2, 3])) for i in range(120)]
    for n in range(3):
        spark.createDataFrame(rows[n * 40 : n * 40 + 40], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(rows, LOG)
    stream = changes.changed(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    changes.sink(stream, str(tmp_path / "assets"), str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination(120)
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert got == sorted(r.event_id for r in state.changes(batch).collect())


def test_window_ids_of_a_column(spark):
    from chronolith.functions import codec

    pairs = [("App.EXE", "T"), ("app.exe", "T"), (None, None), ("", ""), (None, "x")]
    got = [r.id for r in spark.createDataFrame(pairs, "p string, t string").coalesce(1).select(codec.window_id("p", "t").alias("id")).collect()]
    assert got == [codec.window_id_of(*p) for p in pairs] and got[0] == got[1] != 0 and got[2] == got[3] == 0


def test_changes_over_slices(spark):
    rnd = random.Random(12)
    rows = [entry(i, rnd.randrange(400), rnd.randrange(2), 0, rnd.choice([None, 1, 2, 3]), rnd.randrange(4)) for i in range(300)]
    want, last = [], {}
    for r in sorted((r for r in rows if r[9] <= 2), key=lambda r: (r[1], r[0])):
        cell = r[5:8]
        if last.get(cell) is None or (r[8] is not None and last[cell] != r[8]):
            want.append(r)
        last[cell] = r[8]
    df = spark.createDataFrame(rows, LOG)
    for width in (7, 50, 10_000):
        assert sorted(map(tuple, state.changes(df, width).collect())) == sorted(want)


def test_many_stretches_are_searched_as_few_are(spark, monkeypatch):
    rnd = random.Random(13)
    grids = [(rnd.randrange(3), n % 5, (a := rnd.randrange(300)), a + rnd.randrange(60), n) for n in range(40)]
    g = spark.createDataFrame(grids, "monitor_id long, grid long, first_t long, last_t long, row long")
    df = spark.createDataFrame([(i, rnd.randrange(400), rnd.randrange(4)) for i in range(300)], "event_id long, t long, monitor_id long")
    want = sorted(map(tuple, state.geometry_at(df, g).collect()), key=repr)
    monkeypatch.setattr(state, "SENT", 3)
    assert sorted(map(tuple, state.geometry_at(df, g).collect()), key=repr) == want and any(r[1] is None for r in want)
