import pytest
from pyspark.sql import functions as F

from chronolith.streaming import timers

S = 1_000_000


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stream operator over batches of rows, one file and micro-batch each, and returns all its rows."""

    def run(operator, schema, batches):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={n}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(*[str(tmp_path / "in" / "*")])
        out, got = operator(stream), []
        query = out.writeStream.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive
        return sorted(got)

    return run


def test_focus_runs_close_and_are_written_again(streamed):
    rows = [[(1, 0, 7), (1, 10 * S, 7), (1, 31 * S, 7)], [(1, 40 * S, 8), (1, 50 * S, 0), (1, 60 * S, 0), (1, 70 * S, 8)]]
    got = streamed(timers.focus, "monitor_id long, t long, window_id long", rows)
    assert got == sorted([(1, 7, 0, 0), (1, 7, 0, 31 * S), (1, 7, 0, 40 * S), (1, 8, 40 * S, 40 * S), (1, 8, 40 * S, 50 * S), (1, 8, 70 * S, 70 * S)])


def test_heartbeats_keep_their_distance(streamed):
    poll = lambda t, frame=False, paused=False: (1, t * S, frame, paused)
    rows = [[poll(0), poll(10), poll(14, True)], [poll(15, True), poll(16, False, True), poll(17), poll(31), poll(32)]]
    assert streamed(timers.beats, "monitor_id long, t long, frame boolean, paused boolean", rows) == [(1, 0), (1, 17 * S), (1, 32 * S)]


def test_owed_rescans_are_deferred_not_dropped(streamed):
    rows = [[(1, 0, True, 0), (1, 400_000, True, 0)], [(1, 800_000, False, 3), (1, 1_200_000, False, 0), (1, 1_300_000, False, 2), (1, 1_400_000, False, 0)]]
    got = streamed(timers.rescans, "monitor_id long, t long, whole boolean, regions long", rows)
    assert got == [(1, 0, True), (1, 1_200_000, True), (1, 1_300_000, False)]


def test_pointers_are_thinned_over_batches_and_midnight(streamed):
    day = 86_400 * S
    rows = [[(1, day - 20_000, 5, 5, 9)], [(1, day, 50, 50, 9), (1, day + 29_000, 50, 50, 9), (1, day + 40_000, 50, 50, 9), (1, day + 41_000, 50, 50, 0)]]
    got = streamed(timers.thinned, "monitor_id long, t long, x long, y long, asset_hash long", rows)
    assert got == [(1, day - 20_000, 5, 5, 9), (1, day + 40_000, 50, 50, 9), (1, day + 41_000, 50, 50, 0)]


def test_first_seen_against_what_is_stored(spark, streamed):
    stored = spark.createDataFrame([(3,)], "asset_hash long")
    rows = [[(1, 10), (1, 11), (3, 12)], [(1, 13), (2, 14)]]
    seen = lambda s: timers.first_seen(s.withColumn("at", F.timestamp_seconds("t")), stored).select("asset_hash")
    assert streamed(seen, "asset_hash long, t long", rows) == [(1,), (2,)]


def test_thinning_depends_on_kept_rows(streamed):
    rows = [(0, 0, 0, 0, 1), (0, 60_000, 1, 0, 1), (0, 120_000, 2, 0, 1), (0, 130_000, 9, 0, 1), (0, 131_000, 9, 0, 0)]
    got = streamed(timers.thinned, "monitor_id long, t long, x long, y long, asset_hash long", [rows])
    assert [r[1] for r in got] == [0, 120_000, 131_000]
