"""Timelines of a log: idle spans, gaps, focus spans, summaries. Entries meet their neighbours inside slices of a day."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.state import asof

ORDER = ("t", "event_id")

# The reasons of a gap.
RESTARTED = "recording restarted"
STOPPED = "recorder was not watching"
SILENT = "no activity for a long stretch"


def before(rows: DataFrame, *columns: str, slice_us: int = 3_600_000_000, ever=None) -> DataFrame:
    """``rows`` with before_c for each column c: its value in the day's entry before. Entries without a time have no row.

    Windows are keyed by slices of a day; a slice's first entry takes the last one of the day's slice before, which is
    worked out over one row a slice, so that a busy day is no single task. With a condition ``ever`` each row also has
    ``ever``: whether some entry of its day meets it, out of the same rows a slice.
    """
    rows = rows.withColumn("_s", F.floor(F.col("t") / slice_us))
    w = Window.partitionBy("day", "_s").orderBy(*ORDER)
    held = rows.withColumn("_b", F.lag(F.struct(*columns)).over(w))
    some = [] if ever is None else [F.bool_or(F.coalesce(ever, F.lit(False))).alias("_e")]
    lasts = rows.groupBy("day", "_s").agg(F.max_by(F.struct(*columns), F.struct(*ORDER)).alias("_l"), *some)
    whole = [] if ever is None else [F.max("_e").over(Window.partitionBy("day")).alias("ever")]
    lasts = lasts.select(F.col("day").alias("_day"), F.col("_s").alias("_slice"), F.lag("_l").over(Window.partitionBy("day").orderBy("_s")).alias("_l"), *whole)
    met = held.join(lasts, F.col("day").eqNullSafe(F.col("_day")) & (F.col("_s") == F.col("_slice")))
    own = F.coalesce("_b", "_l")
    return met.select(*[c for c in rows.columns if c != "_s"], *[own[c].alias(f"before_{c}") for c in columns], *([] if ever is None else ["ever"]))


def idle_spans(log: DataFrame, gap_us: int = 2_000_000, ops: tuple[int, ...] | None = None) -> DataFrame:
    """(day, start_t, end_t): entries of a day more than gap_us apart; ops restricts the entries that count."""
    rows = log if ops is None else log.filter(F.col("op").isin(*ops))
    spans = before(rows.select("day", "t", "event_id"), "t").select("day", F.col("before_t").alias("start_t"), F.col("t").alias("end_t"))
    return spans.filter(F.col("end_t") - F.col("start_t") > gap_us)


def gaps(log: DataFrame, hole_us: int = 120_000_000, checkpoint_s: int = 180, checkpoints: DataFrame | None = None) -> DataFrame:
    """(day, start_t, end_t, reason): stretches of a day that were not recorded.

    A hole of at least hole_us counts on days with a heartbeat, or where the segment changes (a restart); any other must
    last max(5 min, 2 checkpoints) and hold no checkpoint (day, ts in µs) strictly inside.
    """
    log = log.filter("t > 0").select("day", "t", "event_id", "segment", "op")
    holes = before(log, "t", "segment", ever=F.col("op") == 3).withColumnsRenamed({"before_t": "start_t", "before_segment": "was", "ever": "beats"})
    rows = holes.filter(F.col("t") - F.col("start_t") >= hole_us)
    least = max(300, 2 * checkpoint_s) * 1_000_000
    sure = F.coalesce((F.col("was") != F.col("segment")) | F.col("beats"), F.lit(False))
    reason = F.when(F.col("was") != F.col("segment"), RESTARTED).when(F.col("beats"), STOPPED).otherwise(SILENT)
    rows = rows.filter(sure | (F.col("t") - F.col("start_t") >= least)).select("day", "start_t", F.col("t").alias("end_t"), reason.alias("reason"), sure.alias("sure"))
    if checkpoints is not None:
        c = checkpoints.select(F.col("day").alias("c_day"), F.col("ts").alias("c_ts"))
        inside = (F.col("day") == c.c_day) & ~F.col("sure") & (c.c_ts > F.col("start_t")) & (c.c_ts < F.col("end_t"))
        rows = rows.join(c, inside, "left_anti")
    return rows.drop("sure")


def coalesced(rows: DataFrame, key: str, start: str, end: str, tolerance_us: int, slice_us: int = 86_400_000_000) -> DataFrame:
    """(key, start_t, end_t, n): spans of one key joined while the next starts at most tolerance after the last end.

    First inside slices of time, which leaves fewer spans, then over those; a hot key's rows spread over its slices.
    """

    def joined(spans: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start_t", "end_t")
        reach = F.max("end_t").over(w.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("start_t") - reach <= tolerance_us, 0).otherwise(1)).over(w)
        return spans.withColumn("island", island).groupBy(*by, "island").agg(F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"), F.sum("n").alias("n")).drop("island")

    spans = rows.select(key, F.col(start).alias("start_t"), F.col(end).alias("end_t"), F.lit(1).cast("long").alias("n"), F.floor(F.col(start) / slice_us).alias("_d"))
    return joined(joined(spans, [key, "_d"]).drop("_d"), [key])


def focus_runs(rows: DataFrame, by: list[str], order: list[str], window: str) -> DataFrame:
    """(by, run, window, first, last, n): adjacent rows of one window, in order; a change of window starts a run."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = (~F.col(window).eqNullSafe(F.lag(window).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    runs = rows.withColumn("_new", starts).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run", window).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def upserted(spans: DataFrame, new: DataFrame, tolerance_ms: int = 2000) -> DataFrame:
    """Stored spans (day, app, title, start_ts, end_ts) after new ones are added, day by day in order of their start.

    A new span extends the day's span with the latest end, be it stored or new, if application and title agree and it
    starts at most tolerance after that end; else it is a row of its own. Nulls count as empty. An end never falls; of
    equal ends the first counts.
    """
    key = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("app", "title")]
    old = spans.select("day", *key, "start_ts", "end_ts", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("end_ts"), F.desc("start_ts"), "app", "title")).alias("_n"))
    both = old.filter("_n = 1").drop("_n").withColumn("_new", F.lit(0)).unionByName(new.select("day", *key, "start_ts", "end_ts").withColumn("_new", F.lit(1)))
    w = Window.partitionBy("day").orderBy("_new", "start_ts", "end_ts", "app", "title")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_row", F.row_number().over(w)).withColumn("_end", F.max("end_ts").over(past))
    both = both.withColumn("_latest", F.col("_end").isNull() | (F.col("end_ts") > F.col("_end")))
    held = F.last(F.when(F.col("_latest"), F.struct("app", "title")), ignorenulls=True).over(past)
    same = (held["app"] == F.col("app")) & (held["title"] == F.col("title")) & (F.col("start_ts") - F.col("_end") <= tolerance_ms)
    both = both.withColumn("_same", F.coalesce(same, F.lit(False)))
    island = F.sum((F.col("_latest") & ~F.col("_same")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_i", F.when(F.col("_latest") | F.col("_same"), island).otherwise(-F.col("_row").cast("long")))
    joined = both.groupBy("day", "app", "title", "_i").agg(F.min_by("start_ts", "_row").alias("start_ts"), F.max("end_ts").alias("end_ts")).drop("_i")
    return old.filter("_n > 1").drop("_n").unionByName(joined)


def total_span(spans: DataFrame) -> DataFrame:
    """(day, total_us): the spans (day, start_t, end_t) of each day added up, overlaps counted as often as they occur."""
    return spans.groupBy("day").agg(F.coalesce(F.sum(F.col("end_t") - F.col("start_t")), F.lit(0)).alias("total_us"))


def windows(spans: DataFrame) -> DataFrame:
    """(day, app, title, first_ts): applications and titles of each day and when they came first; nulls count as empty."""
    key = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("app", "title")]
    return spans.groupBy("day", *key).agg(F.min("start_ts").alias("first_ts"))


def sessions(rows: DataFrame) -> DataFrame:
    """(day, start_ts, end_ts): the day's session from any number of sightings; its start only falls, its end only rises."""
    return rows.groupBy("day").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def sightings(rows: DataFrame, key: list[str], keep: int = 64) -> DataFrame:
    """First and last sighting of each geometry; the ``keep`` seen last, oldest first (a limit of the dimension)."""
    merged = rows.groupBy(*key).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return merged.orderBy(F.desc("last_t"), *key).limit(keep).orderBy("first_t", *key)


def gap_at(instants: DataFrame, gaps: DataFrame, slice_us: int = 3_600_000_000) -> DataFrame:
    """(day, instant, start_t, end_t): the gap of the day that holds each instant, both ends included, once an instant.

    Gaps of a day may touch but don't overlap: one that began before the instant and lasts until it comes first, else
    the one that begins with it. As-of searches over slices of a day, so no instant meets all gaps of its day.
    """
    asked = instants.select("day", F.col("instant").alias("t")).distinct()
    span = F.struct("start_t", "end_t").alias("span")
    held = asof(asked, gaps.select("day", (F.col("start_t") + 1).alias("t"), span), "t", ["day"], "span", slice_us).withColumnRenamed("span", "held")
    both = asof(held, gaps.select("day", F.col("start_t").alias("t"), span), "t", ["day"], "span", slice_us)
    pick = F.when(F.col("held.end_t") >= F.col("t"), F.col("held")).when(F.col("span.end_t") >= F.col("t"), F.col("span"))
    return both.withColumn("g", pick).select("day", F.col("t").alias("instant"), "g.start_t", "g.end_t")


def idle_after(spans: DataFrame, at: int) -> DataFrame:
    """At most one row: the first idle span that ends after ``at``, where a player would skip to."""
    return spans.filter(F.col("end_t") > at).orderBy("end_t", "start_t").limit(1)


def next_focus(spans: DataFrame, at: int, app: str, title: str | None = None) -> DataFrame:
    """One row: the next start after ``at`` of an application (any case) and, if given, a title (exact)."""
    rows = spans.filter((F.col("start_t") > at) & (F.lower("app") == app.lower()))
    return (rows if title is None else rows.filter(F.col("title") == title)).agg(F.min("start_t").alias("next_t"))


def heartbeats(log: DataFrame, every_us: int = 15_000_000) -> DataFrame:
    """(day, t): the heartbeats a recorder writes between entries of a day that lie further apart than ``every_us``."""
    quiet = before(log.select("day", "t", "event_id"), "t").filter(F.col("t") - F.col("before_t") > every_us)
    return quiet.select("day", F.explode(F.sequence(F.col("before_t") + every_us, F.col("t") - 1, F.lit(every_us))).alias("t"))


def replay_totals(segments: DataFrame) -> DataFrame:
    """(day, replays, entries, bytes): a day's recorded stretches (rows of ``segment_stats``) added up."""
    return segments.groupBy("day").agg(F.count("*").alias("replays"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))


def segment_stats(log: DataFrame) -> DataFrame:
    """Entries, bounds, distinct windows (of all entries, and of tile entries alone) and bytes of each segment."""
    return log.groupBy("day", "segment").agg(
        F.count("*").alias("entries"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.countDistinct("window_id").alias("distinct_windows_raw"),
        F.countDistinct(F.when(F.col("op") <= 2, F.col("window_id"))).alias("distinct_windows"), (F.count("*") * 27).alias("bytes"),
    )


def day_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("day").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("entries"), F.countDistinct("window_id").alias("windows"),
        (F.count("*") * 27).alias("bytes"), F.countDistinct("monitor_id").alias("monitors"), (F.max("t") - F.min("t")).alias("span_us"),
    )


def day_list(log: DataFrame, sighted: DataFrame, spans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(day, start_ts, end_ts, entries, span_ms, snapshots) for each day of the log, in ms.

    Bounds are the wider of the session's (sighted: day, start_ts, end_ts) and the entries'; 0 stands for none. ``spans`` has
    (day, start_ts, end_ts), ``snapshots`` a row for each. All are aggregated to a row a day before they meet.
    """
    ms = F.floor(F.col("t") / 1000)
    days = log.groupBy("day").agg(F.min(F.when(F.col("t") > 0, ms)).alias("_first"), F.max(ms).alias("_last"), F.count("*").alias("entries"))
    spent = spans.groupBy("day").agg(F.sum(F.col("end_ts") - F.col("start_ts")).alias("span_ms"))
    own = sessions(sighted).withColumnsRenamed({"start_ts": "_from", "end_ts": "_to"})
    met = days.join(own, "day", "left").join(spent, "day", "left").join(snapshots.groupBy("day").agg(F.count("*").alias("snapshots")), "day", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    start = F.least(F.when(F.col("_from") != 0, F.col("_from")), "_first")
    return met.select("day", zero(start).alias("start_ts"), zero(F.greatest("_to", "_last")).alias("end_ts"), "entries", zero(F.col("span_ms")).alias("span_ms"), zero(F.col("snapshots")).alias("snapshots"))


def focus_spans(log: DataFrame) -> DataFrame:
    """(window_id, start_t, end_t, n) of each window, the index's group by application."""
    return log.groupBy("window_id").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"))


def next_after(log: DataFrame, instants: DataFrame) -> DataFrame:
    """(instant, next_t): first entry strictly after each instant, by a merged window over days (forward as-of)."""
    merged = log.select("t", F.lit(0).alias("asks")).unionByName(instants.select(F.col("instant").alias("t"), F.lit(1).alias("asks")))
    # an instant's successor may lie in a later day: fill inside days, then from the next day's first entry
    merged = merged.withColumn("d", F.floor(F.col("t") / 86_400_000_000))
    w = Window.partitionBy("d").orderBy(F.desc("t"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    inside = merged.withColumn("n", F.min(F.when(F.col("asks") == 0, F.col("t"))).over(w))  # asks come before entries at their instant
    firsts = log.groupBy(F.floor(F.col("t") / 86_400_000_000).alias("d")).agg(F.min("t").alias("first"))
    ahead = F.min("first").over(Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1))
    days = merged.select("d").distinct().join(firsts, "d", "left").withColumn("ahead", ahead).select("d", "ahead")  # a row a day
    return inside.filter("asks = 1").join(days, "d").select(F.col("t").alias("instant"), F.coalesce("n", "ahead").alias("next_t"))
