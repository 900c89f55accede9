import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import codec
from chronolith.plans.recording import Recording
from tests.test_parts import LOG

S = 1_000_000


@pytest.fixture(scope="module")
def tiles():
    return {n: np.full((8, 8, 4), 40 * n, np.uint8).tobytes() for n in (1, 2, 3)}


@pytest.fixture(scope="module")
def recording(spark, tiles):
    day = "1970-01-01"
    rows = [(0, 1 * S, 0, 0, 1, 0), (1, 2 * S, 1, 0, 2, 0), (2, 3 * S, 0, 0, 3, 1), (3, 400 * S, 1, 0, 0, 2), (4, 401 * S, 0, 0, 9, 0)]
    log = spark.createDataFrame([(i, t, day, 0, 1, 1, x, y, h, op) for i, t, x, y, h, op in rows], LOG).withColumn("day", F.to_date("day"))
    assets = spark.createDataFrame([(n, 3, bytearray(codec.encode(3, 8, 8, b))) for n, b in tiles.items()], "asset_hash long, codec int, payload binary")
    monitors = spark.createDataFrame([(1, 0, 0, 16, 8, 8)], "monitor_id long, x long, y long, width long, height long, tile_size long")
    spans = spark.createDataFrame([(day, "a", "x", 1000, 3000), (day, "a", "x", 5000, 6000), (day, "b", "", 2000, 2500)], "day string, app string, title string, start_ts long, end_ts long").withColumn("day", F.to_date("day"))
    return Recording(log, assets, monitors, spans)


def picture(tiles, left, right):
    out = np.zeros((8, 16, 4), np.uint8)
    for n, x in ((left, 0), (right, 8)):
        if n in tiles:
            out[:, x : x + 8] = np.frombuffer(tiles[n], np.uint8).reshape(8, 8, 4)
    return out.tobytes()


def test_frames_at_instants(recording, tiles):
    assert bytes(recording.render(2 * S).first().bgra) == picture(tiles, 1, 2)
    assert bytes(recording.render(401 * S).first().bgra) == picture(tiles, 9, 0)  # a missing asset and a cleared cell are holes
    film = {r.instant: r for r in recording.film(1 * S, 5 * S, fps=1).collect()}
    assert {t // S: bytes(r.bgra) for t, r in film.items()} == {1: picture(tiles, 1, 0), 2: picture(tiles, 1, 2), 3: picture(tiles, 3, 2), 4: picture(tiles, 3, 2)}
    assert [(r.start_t // S, r.end_t // S) for r in recording.gaps().collect()] == [(3, 400)]
    assert film[4 * S].gap_start == 3 * S and film[2 * S].gap_start is None and recording.film(0, 1, pictures=False).count() == 1


def test_fidelity_of_frames(spark, recording, tiles):
    truth = [(1, 2 * S, 16, bytearray(picture(tiles, 1, 2))), (1, 5 * S, 16, bytearray(picture(tiles, 3, 1)))]
    r = recording.fidelity(spark.createDataFrame(truth, "monitor_id long, t long, width int, bgra binary")).first()
    assert (r.frames, r.exact, r.pixel_ratio, r.worst, r.worst_at) == (2, 1, 0.75, 0.5, 5 * S)


def test_questions(recording):
    day = datetime.date(1970, 1, 1)
    assert recording.days().first().entries == 5 and recording.info(day).first().last_t == 401 * S
    assert tuple(recording.verify().first()) == (4, 3, 1, "9")
    assert [tuple(r) for r in recording.focus(day).collect()] == [("a", "x", 1000, 6000, 2), ("b", "", 2000, 2500, 1)]
    d = recording.diagnose(1, 0, 0, 3 * S).first()
    assert (d.entries, d.before, d.t, d.asset_hash, d.there) == (3, 2, 3 * S, 3, True)
    empty = recording.diagnose(1, 5, 5, 3 * S).first()
    assert (empty.entries, empty.t, empty.there) == (0, None, False)
    assert recording.idles().count() == 1


def test_purge_and_prune(recording):
    left = recording.purge(2 * S, 2 * S)
    assert left.log.count() == 4 and sorted(r.asset_hash for r in left.assets.collect()) == [1, 3]
    cut = recording.purge(2 * S, 2_200_000)
    assert sorted((r.app, r.start_ts, r.end_ts) for r in cut.spans.collect()) == [("a", 1000, 2000), ("a", 2200, 3000), ("a", 5000, 6000), ("b", 2200, 2500)]
    assert recording.prune("1970-01-09", 3).log.count() == 0 and recording.prune("1970-01-02", 3).assets.count() == 3


def test_snapshots_and_young_files_keep_assets(spark, recording):
    from dataclasses import replace

    tiles = spark.createDataFrame([("1970-01-01", 500 * S, 2)], "day string, t long, asset_hash long").withColumn("day", F.to_date("day"))
    aged = recording.assets.withColumn("mtime_ms", F.when(F.col("asset_hash") == 3, 9_000_000).otherwise(0))
    rec = replace(recording, assets=aged, tiles=tiles)
    left = lambda r: sorted(x.asset_hash for x in r.assets.collect())
    assert left(rec.purge(2 * S, 3 * S)) == [1, 2] and left(rec.purge(2 * S, 3 * S, 10_000_000)) == [1, 2, 3]
    assert left(rec.purge(2 * S, 600 * S)) == [1] and left(replace(rec, tiles=None).purge(2 * S, 3 * S)) == [1]
    assert left(rec.prune("1970-01-09", 3, 10_000_000)) == [3]
    assert tuple(rec.verify().first()) == (4, 3, 1, "9")


def test_a_new_span_extends_the_one_that_ends_last(spark):
    from chronolith.operators import timeline

    kind = "day string, app string, title string, start_ts long, end_ts long"
    old = spark.createDataFrame([("d", "x", None, 0, 10_000)], kind)
    new = spark.createDataFrame([("d", "y", "", 1_000, 2_000), ("d", "x", "", 10_100, 11_000), ("d", "y", "", 14_000, 15_000), ("d", "x", "", 16_000, 17_000)], kind)
    got = sorted(tuple(r) for r in timeline.upserted(old, new).collect())
    assert got == [("d", "x", "", 0, 11_000), ("d", "x", "", 16_000, 17_000), ("d", "y", "", 1_000, 2_000), ("d", "y", "", 14_000, 15_000)]
