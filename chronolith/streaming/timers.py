"""Stateful stream operators of a recorder: focus runs, heartbeats, deferred rescans, pointer thinning, deduplication.

State is a few values for each key. Entries of a micro-batch are put in time order in their key; batches must come in
time order, as from one writer. Steps that depend on the row last kept walk a key's rows of one micro-batch in Python.
These go by the time of the rows alone; ``clocked`` has those that act in silence too.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOCUS = "monitor_id long, window_id long, start_t long, end_t long"
BEAT = "monitor_id long, t long"
RESCAN = "monitor_id long, t long, full boolean"
POINTER = "monitor_id long, t long, x long, y long, asset_hash long"


def _in_order(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(order), kind="stable")


def focus(stream: DataFrame, every_us: int = 30_000_000) -> DataFrame:
    """Spans (monitor_id, window_id, start_t, end_t) of the window in front, from a stream of (monitor_id, t, window_id).

    A change of window closes the run and opens the next one with a span of no length; a run that goes on is written
    again at most every ``every_us``. Window 0 is none (paused, excluded): it closes a run and opens nothing. The rows
    of one run share their start, so the largest end of each (monitor_id, window_id, start_t) is the run.
    """

    def run(key, frames, state: GroupState):
        window, start, flushed = state.get if state.exists else (0, 0, 0)
        out = []
        pdf = _in_order(frames, "t")
        for t, w in zip(pdf.t.tolist(), pdf.window_id.tolist()):
            if w == window:
                if window and t - flushed >= every_us:
                    flushed = t
                    out.append((key[0], window, start, t))
                continue
            if window:
                out.append((key[0], window, start, max(t, start)))
            window, start, flushed = w, t, t
            if window:
                out.append((key[0], window, t, t))
        state.update((window, start, flushed))
        yield pd.DataFrame(out, columns=["monitor_id", "window_id", "start_t", "end_t"])

    rows = stream.selectExpr("cast(monitor_id as long) as monitor_id", "cast(t as long) as t", "coalesce(cast(window_id as long), 0L) as window_id")
    return rows.groupBy("monitor_id").applyInPandasWithState(run, FOCUS, "window long, start long, flushed long", "append", GroupStateTimeout.NoTimeout)


def beats(stream: DataFrame, every_us: int = 15_000_000) -> DataFrame:
    """Heartbeats (monitor_id, t) from a stream of polls (monitor_id, t, frame, paused): a poll that brought no frame and
    isn't paused beats when the last beat is at least ``every_us`` ago; the first such poll always does."""

    def run(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        kept = []
        for t in np.sort(np.concatenate([f.t.to_numpy() for f in frames])).tolist():
            if last is None or t - last >= every_us:
                kept.append(t)
                last = t
        state.update((last,))
        yield pd.DataFrame({"monitor_id": key[0], "t": kept}, columns=["monitor_id", "t"])

    idle = stream.filter("not coalesce(frame, false) and not coalesce(paused, false)").selectExpr("cast(monitor_id as long) as monitor_id", "cast(t as long) as t")
    return idle.groupBy("monitor_id").applyInPandasWithState(run, BEAT, "last long", "append", GroupStateTimeout.NoTimeout)


def rescans(stream: DataFrame, least_us: int = 1_000_000) -> DataFrame:
    """Frames to process (monitor_id, t, full) from a stream of frames (monitor_id, t, whole, regions).

    ``whole`` asks for a scan of the whole frame, else ``regions`` counts the changed ones. Whole scans lie at least
    ``least_us`` apart; one that comes too early is owed: frames wait until the time is over, and the next one is then
    scanned whole, whatever it asks for. A frame without regions that owes nothing is left out.
    """

    def run(key, frames, state: GroupState):
        last, owed = state.get if state.exists else (None, False)
        out = []
        pdf = _in_order(frames, "t")
        for t, whole, regions in zip(pdf.t.tolist(), pdf.whole.tolist(), pdf.regions.tolist()):
            if owed or whole:
                if last is not None and t - last < least_us:
                    owed = True
                else:
                    last, owed = t, False
                    out.append((key[0], t, True))
            elif regions > 0:
                out.append((key[0], t, False))
        state.update((last, owed))
        yield pd.DataFrame(out, columns=["monitor_id", "t", "full"])

    rows = stream.selectExpr("cast(monitor_id as long) as monitor_id", "cast(t as long) as t", "coalesce(whole, false) as whole", "coalesce(cast(regions as long), 0L) as regions")
    return rows.groupBy("monitor_id").applyInPandasWithState(run, RESCAN, "last long, owed boolean", "append", GroupStateTimeout.NoTimeout)


def thinned(stream: DataFrame, pixels: int = 2, wait_us: int = 50_000) -> DataFrame:
    """Pointer entries (monitor_id, t, x, y, asset_hash) worth keeping: the shape changed (hash 0 is hidden), or it moved by
    at least ``pixels`` and ``wait_us`` after the last kept one, whatever the day. A monitor's first entry is kept."""

    def run(key, frames, state: GroupState):
        last = state.get if state.exists else None
        pdf = _in_order(frames, "t", "x", "y", "asset_hash")
        keep = []
        for n, (t, x, y, shape) in enumerate(zip(pdf.t.tolist(), pdf.x.tolist(), pdf.y.tolist(), pdf.asset_hash.tolist())):
            far = last is not None and max(abs(x - last[1]), abs(y - last[2])) >= pixels and t - last[0] >= wait_us
            if last is None or shape != last[3] or far:
                keep.append(n)
                last = (t, x, y, shape)
        state.update(last)
        yield pdf.iloc[keep]

    rows = stream.selectExpr(*(f"cast({c} as long) as {c}" for c in ("monitor_id", "t", "x", "y", "asset_hash")))
    return rows.groupBy("monitor_id").applyInPandasWithState(run, POINTER, "t long, x long, y long, asset_hash long", "append", GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, stored: DataFrame | None = None, key: str = "asset_hash", at: str = "at", late: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key is new: once within the watermark (on the timestamp ``at``), and not among the keys that
    ``stored`` had when the stream was defined. State lasts as long as the watermark, so a key that returns after it comes
    again; ``stores.store`` looks every batch up in the store and keeps one copy."""
    fresh = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return fresh if stored is None else fresh.join(stored.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
