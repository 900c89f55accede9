import time

import pandas as pd
import pytest

from chronolith.streaming import clocked, seeded

S = 1_000_000


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Clock:
    """A handle, timer values and expired-timer info of one key, driven by hand."""

    def __init__(self, processor):
        self.now, self.timers, self.value, self.processor = 0, [], Value(), processor
        processor.init(self)

    def getValueState(self, name, schema):
        return self.value

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs

    def until(self, ms):
        """Lets time pass; rows that timers make."""
        out = []
        while self.timers and min(self.timers) <= ms:
            self.now = min(self.timers)
            self.timers.remove(self.now)
            out += [tuple(r) for f in self.processor.handleExpiredTimer((1,), self, self) for r in f.itertuples(index=False)]
        self.now = ms
        return out

    def rows(self, **columns):
        return [tuple(r) for f in self.processor.handleInputRows((1,), iter([pd.DataFrame(columns)]), self) for r in f.itertuples(index=False)]


def test_silence_alone_beats_until_life_ends():
    c = Clock(clocked.Beats(15 * S, 60_000))
    assert c.rows(t=[0], frame=[False], paused=[False]) == [(1, 0)]
    assert c.until(46_000) == [(1, 15 * S), (1, 30 * S), (1, 45 * S)]
    assert c.rows(t=[50 * S], frame=[True], paused=[False]) == []
    assert c.until(61_000) == [(1, 60 * S)]
    assert c.rows(t=[62 * S], frame=[False], paused=[True]) == [] and c.until(100_000) == []
    assert c.rows(t=[100 * S], frame=[False], paused=[False]) == [(1, 100 * S)]
    assert c.until(10_000_000) == [(1, t * S) for t in (115, 130, 145)]
    assert not c.value.exists() and not c.timers


def test_silence_closes_a_run():
    c = Clock(clocked.Focus(30 * S, 120_000, 600_000))
    assert c.rows(t=[0, 31 * S], window_id=[7, 7]) == [(1, 7, 0, 0), (1, 7, 0, 31 * S)]
    assert c.until(119_000) == [] and c.until(121_000) == [(1, 7, 0, 31 * S)]
    c.now = 130_000
    assert c.rows(t=[130 * S, 140 * S], window_id=[7, 8]) == [(1, 7, 130 * S, 130 * S), (1, 7, 130 * S, 140 * S), (1, 8, 140 * S, 140 * S)]
    assert c.until(10_000_000) == [(1, 8, 140 * S, 140 * S)] and not c.value.exists() and not c.timers


def test_an_owed_rescan_is_paid_in_silence():
    c = Clock(clocked.Rescans(1 * S, 60_000))
    assert c.rows(t=[0, 400_000], whole=[True, True], regions=[0, 0]) == [(1, 0, True)]
    assert c.until(999) == [] and c.until(5_000) == [(1, 1 * S, True)]
    assert c.rows(t=[5 * S, 5_100_000], whole=[False, False], regions=[2, 0]) == [(1, 5 * S, False)]
    assert c.until(200_000) == [] and not c.value.exists()
    early = Clock(clocked.Rescans(90 * S, 60_000))  # life ends before the scan is due: it is still made
    assert early.rows(t=[0, 1], whole=[True, True], regions=[0, 0]) == [(1, 0, True)]
    assert early.until(61_000) == [(1, 90 * S, True)] and not early.value.exists()


@pytest.mark.parametrize("kind", ["beats", "rescans"])
def test_timers_fire_in_a_stream_without_rows(spark, tmp_path, kind):
    spark.conf.set(*seeded.PROVIDER)
    got = []
    try:
        now = int(time.time() * S)
        if kind == "beats":
            schema, rows = "monitor_id long, t long, frame boolean, paused boolean", [(1, now, False, False), (2, now, False, True)]
            operator = lambda s: clocked.beats(s, every_us=2 * S)
        else:
            schema, rows = "monitor_id long, t long, whole boolean, regions long", [(1, now, True, 0), (1, now + 10, True, 0)]
            operator = lambda s: clocked.rescans(s, least_us=2 * S)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
        out = operator(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = out.writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
        until = time.time() + 90
        while len(got) < (3 if kind == "beats" else 2) and time.time() < until and query.isActive:
            time.sleep(0.2)
        assert query.exception() is None
        query.stop()
    finally:
        spark.conf.unset(seeded.PROVIDER[0])
    assert {r[0] for r in got} == {1} and got[0][1] == now and all(b[1] - a[1] >= 2 * S - 1000 for a, b in zip(got, got[1:]))
    assert len(got) >= (3 if kind == "beats" else 2) and (kind == "beats" or got[:2] == [(1, now, True), (1, got[1][1], True)])
