"""Stream operators that act when nothing comes: timers on the clock, in state that goes with its monitor.

A row's time (t, µs) says when it happened; a timer's is the clock's, so both should come from clocks that agree. Timers
wake a monitor even where no batch has rows for it. State is a few values a monitor, and is dropped when the monitor has
been silent for its ``life``. These need the RocksDB state store (``seeded.PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BEAT = "monitor_id long, t long"
FOCUS = "monitor_id long, window_id long, start_t long, end_t long"
RESCAN = "monitor_id long, t long, full boolean"
#: Milliseconds of silence after which a monitor's state is dropped.
LIFE = 3_600_000


class _Clocked(StatefulProcessor):
    """State ``fields`` of a monitor, one timer, and its end of life. Subclasses say what rows and the timer do."""

    fields, columns = "", ()

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.fields}, heard long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.state.get()[:-1] if self.state.exists() else None
        pdf = pd.concat(list(rows)).sort_values("t", kind="stable")
        out, held, wake = self.on_rows(key[0], held, pdf, now)
        self._keep(held, now, now, wake)
        yield pd.DataFrame(out, columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        *held, heard = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if now - heard >= self.life_ms:
            out = self.at_end(key[0], held)
            self.state.clear()
        else:
            out, held, wake = self.on_timer(key[0], held, now, heard)
            self._keep(held, heard, now, wake)
        yield pd.DataFrame(out, columns=list(self.columns))

    def _keep(self, held, heard: int, now: int, wake: int | None) -> None:
        """Stores the state; one timer is left: for what is due next, or for the end of life."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = heard + self.life_ms
        self.handle.registerTimer(max(now + 1, min(end, end if wake is None else wake)))
        self.state.update((*held, heard))

    def at_end(self, monitor, held) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


class Beats(_Clocked):
    fields, columns = "last long, paused boolean", ("monitor_id", "t")

    def __init__(self, every_us: int, life_ms: int):
        super().__init__(life_ms)
        self.every = every_us

    def on_rows(self, monitor, held, pdf, now):
        last, paused = held or (None, False)
        out = []
        for t, frame, stopped in zip(pdf.t.tolist(), pdf.frame.tolist(), pdf.paused.tolist()):
            paused = stopped
            if not frame and not paused and (last is None or t - last >= self.every):
                last = t
                out.append((monitor, t))
        return out, (last, paused), self._wake(last, paused, now)

    def on_timer(self, monitor, held, now, heard):
        last, paused = held
        out = []
        if not paused and (last is None or now * 1000 - last >= self.every):
            last = now * 1000
            out.append((monitor, last))
        return out, (last, paused), self._wake(last, paused, now)

    def _wake(self, last, paused, now):
        if paused:
            return None
        return now + self.every // 1000 if last is None else -(-(last + self.every) // 1000)


class Focus(_Clocked):
    fields, columns = "window long, start long, flushed long, seen long", ("monitor_id", "window_id", "start_t", "end_t")

    def __init__(self, every_us: int, silence_ms: int, life_ms: int):
        super().__init__(life_ms)
        self.every, self.silence = every_us, silence_ms

    def on_rows(self, monitor, held, pdf, now):
        window, start, flushed, seen = held or (0, 0, 0, 0)
        out = []
        for t, w in zip(pdf.t.tolist(), pdf.window_id.tolist()):
            if w != window:
                out += [(monitor, window, start, max(t, start))] if window else []
                window, start, flushed = w, t, t
                out += [(monitor, w, t, t)] if w else []
            elif window and t - flushed >= self.every:
                flushed = t
                out.append((monitor, window, start, t))
            seen = t
        return out, (window, start, flushed, seen), now + self.silence if window else None

    def on_timer(self, monitor, held, now, heard):
        window, start, flushed, seen = held
        if window and now - heard >= self.silence:
            return [(monitor, window, start, max(seen, start))], (0, 0, 0, seen), None
        return [], held, heard + self.silence if window else None

    def at_end(self, monitor, held):
        window, start, _, seen = held
        return [(monitor, window, start, max(seen, start))] if window else []


class Rescans(_Clocked):
    fields, columns = "last long, owed boolean", ("monitor_id", "t", "full")

    def __init__(self, least_us: int, life_ms: int):
        super().__init__(life_ms)
        self.least = least_us

    def on_rows(self, monitor, held, pdf, now):
        last, owed = held or (None, False)
        out = []
        for t, whole, regions in zip(pdf.t.tolist(), pdf.whole.tolist(), pdf.regions.tolist()):
            if owed or whole:
                owed = last is not None and t - last < self.least
                if not owed:
                    last = t
                    out.append((monitor, t, True))
            elif regions > 0:
                out.append((monitor, t, False))
        return out, (last, owed), -(-(last + self.least) // 1000) if owed else None

    def on_timer(self, monitor, held, now, heard):
        last, owed = held
        if not owed:
            return [], held, None
        due = last + self.least
        if now * 1000 < due:
            return [], held, -(-due // 1000)
        return [(monitor, now * 1000, True)], (now * 1000, False), None

    def at_end(self, monitor, held):
        last, owed = held
        return [(monitor, last + self.least, True)] if owed else []


def _run(rows: DataFrame, processor: _Clocked, schema: str) -> DataFrame:
    return rows.groupBy("monitor_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="processingTime")


def beats(stream: DataFrame, every_us: int = 15_000_000, life_ms: int = LIFE) -> DataFrame:
    """Heartbeats (monitor_id, t) of monitors that are heard of in a stream of polls (monitor_id, t, frame, paused).

    A poll that brought no frame and isn't paused beats when the last beat is at least ``every_us`` ago; where no poll
    comes, the clock beats in its place, until a poll says that the monitor is paused or its life has passed in silence.
    """
    rows = stream.selectExpr("cast(monitor_id as long) as monitor_id", "cast(t as long) as t", "coalesce(frame, false) as frame", "coalesce(paused, false) as paused")
    return _run(rows, Beats(every_us, life_ms), BEAT)


def focus(stream: DataFrame, every_us: int = 30_000_000, silence_ms: int = 120_000, life_ms: int = LIFE) -> DataFrame:
    """Spans as ``timers.focus`` gives them; a run of which nothing is heard for ``silence_ms`` is closed at the row last
    seen, and a later row of its window begins a new one."""
    rows = stream.selectExpr("cast(monitor_id as long) as monitor_id", "cast(t as long) as t", "coalesce(cast(window_id as long), 0L) as window_id")
    return _run(rows, Focus(every_us, silence_ms, life_ms), FOCUS)


def rescans(stream: DataFrame, least_us: int = 1_000_000, life_ms: int = LIFE) -> DataFrame:
    """Frames to process as ``timers.rescans`` gives them; a whole scan that is owed is made as soon as the time between
    scans is over, whether a frame comes or not."""
    rows = stream.selectExpr("cast(monitor_id as long) as monitor_id", "cast(t as long) as t", "coalesce(whole, false) as whole", "coalesce(cast(regions as long), 0L) as regions")
    return _run(rows, Rescans(least_us, life_ms), RESCAN)
