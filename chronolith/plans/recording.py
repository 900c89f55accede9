"""The questions a user asks of a recording, each answered by a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators import render, state, store, timeline, verify


@dataclass(frozen=True)
class Recording:
    """Tables of a recording.

    ``log``: event_id, t, day, segment, window_id, monitor_id, tile_x, tile_y, asset_hash, op. ``assets``: asset_hash,
    codec, payload. ``monitors``: monitor_id, x, y, width, height, tile_size. ``spans``: day, app, title, start_ts, end_ts.
    ``checkpoints``: day, ts (µs). ``tiles``: day, t (µs), asset_hash, the filled tiles of snapshots, which keep their
    assets as the log's entries do. Only the tables that a question needs must be there.
    """

    log: DataFrame
    assets: DataFrame | None = None
    monitors: DataFrame | None = None
    spans: DataFrame | None = None
    checkpoints: DataFrame | None = None
    tiles: DataFrame | None = None

    def days(self) -> DataFrame:
        """All days, newest first, with their entries, bounds and windows."""
        return timeline.day_summary(self.log).orderBy(F.desc("day"))

    def info(self, day) -> DataFrame:
        """Segments of a day in order of their start."""
        return timeline.segment_stats(self.log.filter(F.col("day") == F.lit(day))).orderBy("first_t")

    def totals(self) -> DataFrame:
        """Recorded stretches, entries and bytes of each day."""
        return timeline.replay_totals(timeline.segment_stats(self.log))

    def rows(self, kind: str) -> DataFrame:
        """(message): one JSON text of kind 'days', 'replays' or 'gaps' for each day, as a display asks for them."""
        what = {"days": self.days, "replays": lambda: timeline.segment_stats(self.log), "gaps": self.gaps}[kind]()
        rest = F.struct(*sorted(c for c in what.columns if c != "day"))
        listed = what.groupBy("day").agg(F.sort_array(F.collect_list(rest)).alias(kind))  # a day's stretches are few
        return listed.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.col("day"), F.col(kind))).alias("message"))

    def state(self, at: int) -> DataFrame:
        return state.fold(self.log, at)

    def render(self, at: int) -> DataFrame:
        """A frame of each monitor at an instant."""
        return render.rendered(self.state(at), render.decoded(self.assets), self.monitors)

    def film(self, start: int, end: int, fps: float = 10.0, speed: float = 1.0, pictures: bool = True) -> DataFrame:
        """Frames at fixed steps of time, with the gap that each instant falls in.

        Frames a second lie between 1 and 120, the speed between 0.05 and 100; there is one frame at least. Without
        ``pictures`` there are (instant, start_t, end_t) alone.
        """
        step = max(1, round(min(100.0, max(0.05, speed)) / min(120.0, max(1.0, fps)) * 1_000_000))
        count = max(1, (end - start) // step)
        instants = self.log.sparkSession.range(count).select((F.lit(start) + F.col("id") * step).alias("instant"))
        dated = instants.withColumn("day", F.to_date(F.timestamp_micros("instant")))
        plan = timeline.gap_at(dated, self.gaps()).select("instant", F.col("start_t").alias("gap_start"), F.col("end_t").alias("gap_end"))
        if not pictures:
            return plan
        at = F.explode(F.sequence(F.lit(start), F.lit(start + (count - 1) * step), F.lit(step))).alias("at")
        points = self.monitors.select("monitor_id", at)
        keys = state.folds(self.log, render.key_points(points, 32 * step))
        frames = render.filmed(self.log, points, keys, render.decoded(self.assets), self.monitors, 32 * step)
        return plan.join(frames.withColumnRenamed("at", "instant"), "instant", "left")

    def fidelity(self, truth: DataFrame, tolerance: int = 0, monitors: list[int] | None = None) -> DataFrame:
        """How well frames (monitor_id, t, width, bgra) taken from the screen are kept in the log, tile by tile; of some
        monitors alone if they are named."""
        truth = truth if monitors is None else truth.filter(F.col("monitor_id").isin(monitors))
        both = truth.select("monitor_id", F.col("t").alias("at"), F.col("width").cast("int").alias("width"), F.floor(F.octet_length("bgra") / 4 / F.col("width")).cast("int").alias("height"), "bgra")
        cells = state.folds(self.log, both.select("monitor_id", "at"))
        diffs = render.tile_diff(both, cells, self.assets, self.monitors, tolerance=tolerance)
        return verify.fidelity(diffs.withColumnRenamed("pixels", "elements"), "at")

    def verify(self) -> DataFrame:
        """Whether every asset that the log names is there."""
        named = self._named(self.log.filter("op <= 1"), self.tiles).select(F.col("asset_hash").alias("asset"))
        return verify.integrity(named, self.assets.select(F.col("asset_hash").alias("asset")))

    def focus(self, day) -> DataFrame:
        """Applications and titles of a day with their first start, last end and number of spans."""
        rows = self.spans.filter(F.col("day") == F.lit(day)).groupBy("app", "title")
        return rows.agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n")).orderBy("start_ts", "app", "title")

    def gaps(self) -> DataFrame:
        return timeline.gaps(self.log, checkpoints=self.checkpoints)

    def idles(self, gap_us: int = 2_000_000) -> DataFrame:
        return timeline.idle_spans(self.log, gap_us)

    def diagnose(self, monitor_id: int, tile_x: int, tile_y: int, at: int) -> DataFrame:
        """One row about a cell: entries, those up to an instant, the last of them, and whether its asset is there."""
        rows = self.log.filter((F.col("op") <= 2) & (F.col("monitor_id") == monitor_id) & (F.col("tile_x") == tile_x) & (F.col("tile_y") == tile_y))
        past = F.col("t") <= at
        last = rows.agg(F.count("*").alias("entries"), F.count_if(past).alias("before"), F.max_by(F.struct("t", "op", "asset_hash"), F.when(past, F.struct("t", "event_id"))).alias("last"))
        found = last.select("entries", "before", F.col("last.t").alias("t"), F.col("last.op").alias("op"), F.col("last.asset_hash").alias("asset_hash"))
        there = self.assets.select("asset_hash", F.lit(True).alias("there")).dropDuplicates(["asset_hash"])
        return found.join(there, "asset_hash", "left").withColumn("there", F.coalesce("there", F.lit(False)))

    @staticmethod
    def _named(log: DataFrame, tiles: DataFrame | None) -> DataFrame:
        """(asset_hash) of all assets that entries or snapshots name, each once."""
        named = log.select("asset_hash")
        return (named if tiles is None else named.union(tiles.select("asset_hash"))).filter("asset_hash <> 0").distinct()

    def _kept(self, log: DataFrame, tiles: DataFrame | None, now_ms: int | None, grace_ms: int) -> DataFrame | None:
        """Assets that are named, or (given the time) whose file, mtime_ms, is younger than the grace."""
        if self.assets is None:
            return None
        met = self.assets.join(self._named(log, tiles).withColumn("_named", F.lit(True)), "asset_hash", "left")
        young = F.lit(False) if now_ms is None else F.col("mtime_ms") > now_ms - grace_ms
        return met.filter(F.col("_named").isNotNull() | young).select(*self.assets.columns)

    def purge(self, start: int, end: int, now_ms: int | None = None, grace_ms: int = 3_600_000) -> Recording:
        """The recording without a closed range of time, and without the assets that only it named."""
        left, out = store.purge(self.log, start, end), lambda t, at: t and t.filter(~F.col(at).between(start, end))
        tiles = out(self.tiles, "t")
        return Recording(left, self._kept(left, tiles, now_ms, grace_ms), self.monitors, self.spans and self._cut(start // 1000, end // 1000), out(self.checkpoints, "ts"), tiles)

    def _cut(self, start_ms: int, end_ms: int) -> DataFrame:
        spans = self.spans.withColumnsRenamed({"start_ts": "start_t", "end_ts": "end_t"})
        return store.subtract(spans, start_ms, end_ms).withColumnsRenamed({"start_t": "start_ts", "end_t": "end_ts"})

    def prune(self, today, days: int, now_ms: int | None = None, grace_ms: int = 3_600_000) -> Recording:
        """The recording's last days, and the assets that they name."""
        kept = lambda t: t and store.retained(t, today, days)
        left, tiles = kept(self.log), kept(self.tiles)
        return Recording(left, self._kept(left, tiles, now_ms, grace_ms), self.monitors, kept(self.spans), kept(self.checkpoints), tiles)
