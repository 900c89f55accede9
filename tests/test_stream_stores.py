import random
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import timeline
from chronolith.sources import maintenance
from chronolith.streaming import stores

ENTRY = "event_id long, t long, asset_hash long, payload binary"
SPAN = "day date, app string, title string, start_ts long, end_ts long"


@pytest.fixture
def feed(spark, tmp_path):
    """Adds a file (a micro-batch) of rows, and opens the stream of all."""

    class Feed:
        n = 0

        def add(self, rows, schema):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={self.n:03d}"))
            self.n += 1

        def stream(self, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    return Feed()


def entries(*hashes, first=0):
    return [(first + i, (first + i) * 1_000_000, h, bytearray(b"%d" % (h or 0))) for i, h in enumerate(hashes)]


def done(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_one_copy_of_each_asset_after_restarts(spark, feed, tmp_path):
    at = [str(tmp_path / n) for n in ("assets", "log", "cp")]
    feed.add(entries(1, 2, 2, 0, None), ENTRY)
    feed.add(entries(2, 3, first=10), ENTRY)
    done(stores.store(feed.stream(ENTRY), *at, capacity=2))  # so small that keys are forgotten and found in the store
    feed.add(entries(1, 4, 3, first=20), ENTRY)
    feed.add(entries(9, 8, 7, 1, 2, first=30), ENTRY)
    feed.add(entries(1, 2, 4, 9, first=40), ENTRY)
    done(stores.store(feed.stream(ENTRY), *at, capacity=4))
    stored = spark.read.parquet(at[0])
    assert sorted((r.asset_hash, bytes(r.payload)) for r in stored.collect()) == [(h, b"%d" % h) for h in (1, 2, 3, 4, 7, 8, 9)]
    log = spark.read.parquet(at[1])
    assert sorted(r.event_id for r in log.collect()) == [0, 1, 2, 3, 4, 10, 11, 20, 21, 22, *range(30, 35), *range(40, 44)] and "payload" not in log.columns
    assert log.filter("day = date'1970-01-01' and batch = 2").count() == 3


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    kept = stores.Store(spark, str(tmp_path / "a"), str(tmp_path / "l"))
    frame = lambda *h: spark.createDataFrame(entries(*h), ENTRY)
    kept.write(frame(1, 2), 0)
    kept.write(frame(2, 3), 1)
    again = stores.Store(spark, str(tmp_path / "a"), str(tmp_path / "l"))  # a restart: nothing is in front
    again.write(frame(2, 3), 1)
    again.write(frame(3, 1, 5), 2)
    assert sorted((r.asset_hash, r.batch) for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [(1, 0), (2, 0), (3, 1), (5, 2)]
    assert spark.read.parquet(str(tmp_path / "l")).count() == 7


def test_known_keys_need_no_look_at_the_store(spark, tmp_path):
    kept = stores.Store(spark, str(tmp_path / "a"), str(tmp_path / "l"))
    frame = lambda *h: spark.createDataFrame(entries(*h), ENTRY)
    kept.write(frame(1, 2), 0)
    kept.write(frame(2, 1, 0), 1)
    assert kept.probes == 1
    seeded = stores.Store(spark, str(tmp_path / "a"), str(tmp_path / "l"))
    seeded.seed(spark.read.parquet(str(tmp_path / "a")))
    seeded.write(frame(1, 2), 2)
    assert seeded.probes == 0 and spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_two_generations_are_bounded():
    rnd, seen = random.Random(2), stores.Seen(100)
    for _ in range(50):
        keys = np.array([rnd.randrange(1000) for _ in range(rnd.randrange(1, 160))], np.int64)
        seen.add(keys)
        assert len(seen) <= 100 and len(seen.young) <= 50 and (len(keys) > 50 or all(int(k) in seen for k in keys))
    seen = stores.Seen(4)
    for k in (1, 2, 3):
        seen.add(np.array([k]))
    assert 1 in seen and 3 in seen
    seen.add(np.array([4, 5]))
    seen.add(np.array([6]))
    assert 1 not in seen and 6 in seen


def spans(seed):
    rnd, out, t = random.Random(seed), [], 0
    for _ in range(60):
        t += rnd.choice([0, 500, 1500, 2500, 9000])
        out.append((date(2024, 1, 1 + t // 60_000), rnd.choice(["a", "a", "b"]), rnd.choice(["x", None, ""]), t, t + rnd.choice([0, 400, 3000])))
    return out


@pytest.mark.parametrize("sizes", [(60,), (1, 2, 3, 30, 24)])
def test_index_merges_equal_the_whole(spark, feed, tmp_path, sizes):
    rows, at = spans(5), 0
    for n in sizes:
        feed.add(rows[at : at + n], SPAN)
        at += n
    paths = [str(tmp_path / n) for n in ("sessions", "spans", "cp")]
    done(stores.merge_index(feed.stream(SPAN), *paths))
    whole = spark.createDataFrame(rows, SPAN)
    want = timeline.upserted(whole.limit(0), whole)
    got = spark.read.parquet(paths[1]).select("day", "app", "title", "start_ts", "end_ts")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(got.columns).collect()))
    sessions = spark.read.parquet(paths[0]).select("day", "start_ts", "end_ts")
    assert sorted(map(tuple, sessions.collect())) == sorted(map(tuple, timeline.sessions(whole).collect()))


def test_a_merge_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "sessions"), spans(6)
    frame = lambda part: timeline.sessions(spark.createDataFrame(part, SPAN))
    both = lambda old, new: timeline.sessions(old.unionByName(new))
    first = stores.merge_days(spark, path, 0, frame(rows[:30]), both)
    assert first and stores.merge_days(spark, path, 0, frame(rows[:30]), both) == []
    monkeypatch.setattr(maintenance.Folder, "finish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        stores.merge_days(spark, path, 1, frame(rows[30:]), both)
    monkeypatch.undo()
    assert stores.merge_days(spark, path, 1, frame(rows[30:]), both) == []  # the plan was there: its end came first
    got = spark.read.parquet(path).select("day", "start_ts", "end_ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frame(rows).collect()))
    assert got.groupBy("day").count().filter(F.col("count") > 1).isEmpty()
