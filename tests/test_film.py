import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import codec
from chronolith.operators import render, state
from tests.test_parts import LOG, entry

MONITORS = "monitor_id long, x long, y long, width long, height long, tile_size long"


@pytest.fixture(scope="module")
def recording(spark):
    """A log of random draws and clears on two monitors, its assets (some missing, one broken, one lossy) and monitors."""
    rnd, rng = random.Random(3), np.random.default_rng(3)
    assets, rows = [], []
    for n in range(24):
        px = rng.integers(0, 256, (8, 8, 4), dtype=np.uint8)
        c = 2 if n == 5 else rnd.choice([1, 3])
        assets.append((codec.tile_hash_of(8, 8, px.tobytes()), c, bytearray(codec.encode(c, 8, 8, px.tobytes()))))
    hashes = [a[0] for a in assets] + [0, 12345]
    assets[7] = (assets[7][0], 1, bytearray(b"qoif broken"))
    for i in range(500):
        op = rnd.choice([0, 0, 0, 0, 1, 2, 3])
        m = rnd.randrange(1, 3)
        rows.append((i, i * 10 + rnd.choice([0, 0, -9]), "d", 0, 1, m, rnd.randrange(-2, 2), rnd.randrange(2), rnd.choice(hashes), op))
    monitors = [(1, -10, 0, 20, 12, 8), (2, 0, 0, 16, 16, 8), (3, 0, 0, 8, 8, 8)]
    return spark.createDataFrame(rows, LOG), spark.createDataFrame(assets, "asset_hash long, codec int, payload binary"), spark.createDataFrame(monitors, MONITORS)


def frames(df):
    return sorted((r.monitor_id, r["at"], r.width, r.height, bytes(r.bgra)) for r in df.collect())


@pytest.mark.parametrize("slice_us", [100, 900, 100_000])
def test_a_film_of_changed_cells_equals_the_rendered_frames(spark, recording, slice_us):
    log, assets, monitors = recording
    points = spark.createDataFrame([(m, at) for m in (1, 2, 3) for at in [*range(-50, 5200, 130), 700, 701]], "monitor_id long, at long")
    tiles = render.decoded(assets)
    want = render.rendered(state.folds(log, points), tiles, monitors, ("monitor_id", "at"))
    keys = state.folds(log, render.key_points(points, slice_us))
    got = render.filmed(log, points, keys, tiles, monitors, slice_us)
    assert frames(got) == frames(want) and len(frames(got)) > 60


def test_traffic_follows_the_changes(spark, recording):
    log, _, _ = recording
    points = spark.createDataFrame([(1, at, state.LOWEST) for at in range(0, 100_000, 10)], "monitor_id long, at long, base long")
    assert state.arrivals(log, points).count() <= log.filter("op <= 2").count()
    one = spark.createDataFrame([(1, 10_000, state.LOWEST)], "monitor_id long, at long, base long")
    assert state.arrivals(log, one).count() == log.filter("op <= 2 and monitor_id = 1").select("tile_x", "tile_y").distinct().count()


@pytest.mark.parametrize("tolerance", [0, 5])
def test_tile_diff_equals_pixel_diff(spark, recording, tolerance):
    log, assets, monitors = recording
    points = spark.createDataFrame([(m, at) for m in (1, 2) for at in range(-50, 5200, 400)], "monitor_id long, at long")
    cells = state.folds(log, points)
    shown = render.rendered(cells, render.decoded(assets), monitors, ("monitor_id", "at"))
    rnd, truth = random.Random(9), []
    for r in shown.collect():
        px = np.frombuffer(r.bgra, np.uint8).reshape(r.height, r.width, 4).copy()
        for _ in range(rnd.choice([0, 0, 1, 3])):
            px[rnd.randrange(r.height), rnd.randrange(r.width), rnd.randrange(4)] ^= rnd.choice([1, 4, 8, 255])
        truth.append((r.monitor_id, r["at"], r.width, r.height, bytearray(px.tobytes())))
    truth += [(2, -50, 16, 16, bytearray(bytes(16 * 16 * 4))), (1, 50, 4, 4, bytearray(bytes(64)))]
    truth = spark.createDataFrame([t for t in truth if t[:2] != (1, 350)], "monitor_id long, at long, width int, height int, bgra binary")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in render.tile_diff(truth, cells, assets, monitors, tolerance=tolerance).collect()}
    both = truth.withColumnRenamed("bgra", "truth").join(shown.select("monitor_id", "at", "bgra"), ["monitor_id", "at"], "left")
    want = {tuple(r)[:2]: tuple(r)[2:] for r in render.pixel_diff(both, ("monitor_id", "at"), "truth", "bgra", tolerance).collect()}
    assert {k: v[:7] for k, v in got.items()} == want
    decoded, tiles = sum(v[8] for v in got.values()), sum(v[7] for v in got.values())
    assert 0 < decoded < tiles / 2


def test_exact_frames_decode_nothing(spark, recording):
    log, assets, monitors = recording
    at = spark.createDataFrame([(2, 3000)], "monitor_id long, at long")
    plain = assets.filter("codec <> 2").filter(F.length("payload") > 20)
    cells = state.folds(log, at).join(plain.select("asset_hash"), "asset_hash", "left_semi")
    shown = render.rendered(cells, render.decoded(plain), monitors, ("monitor_id", "at"))
    (r,) = render.tile_diff(shown, cells, plain, monitors).collect()
    assert (r.mismatches, r.max_delta, r.left, r.pixels, r.tiles, r.decoded) == (0, 0, None, 256, 4, 0)
