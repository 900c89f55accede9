"""State at an instant: folds, changes, as-of and interval joins."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ("monitor_id", "tile_x", "tile_y")


def fold(log: DataFrame, at: int, base: DataFrame | None = None, base_t: int | None = None) -> DataFrame:
    """(cell, asset_hash): last tile operation of each cell at or before ``at``; cleared cells are left out.

    With a base (cells of a snapshot taken at base_t) only entries after it are read, and cells they do not touch
    keep the snapshot's content. A partial aggregate, so one row for each cell and task is shuffled.
    """
    rows = log.filter((F.col("op") <= 2) & (F.col("t") <= at))
    if base is not None and base_t is not None:
        rows = rows.filter(F.col("t") > base_t)
    last = rows.groupBy(*CELL).agg(F.max_by(F.struct("op", "asset_hash"), F.struct("t", "event_id")).alias("last"))
    now = last.select(*CELL, F.when(F.col("last.op") != 2, F.col("last.asset_hash")).alias("asset_hash"))
    if base is not None:
        old = base.select(*CELL, F.col("asset_hash").alias("old")).withColumn("has", F.lit(True))
        now = now.withColumn("touched", F.lit(True)).join(old, list(CELL), "full")
        now = now.select(*CELL, F.when(F.col("touched"), F.col("asset_hash")).otherwise(F.col("old")).alias("asset_hash"))
    return now.filter("asset_hash is not null")


def canvas_stats(cells: DataFrame) -> DataFrame:
    """(monitor_id, filled, contents): cells with content of each monitor, and how many different contents they have."""
    full = cells.filter("asset_hash <> 0")
    return full.groupBy("monitor_id").agg(F.count("*").alias("filled"), F.countDistinct("asset_hash").alias("contents"))


def changes(log: DataFrame, slice_us: int = 86_400_000_000) -> DataFrame:
    """Tile entries whose content differs from the cell's previous one; a cell's first entry counts.

    Entries meet inside slices of time; a slice's first one takes what the cell's slice before ended with, over a row for
    each cell and slice, so a cell that changes all the time spreads over as many tasks as it has slices.
    """
    rows = log.filter("op <= 2").withColumn("_d", F.floor(F.col("t") / slice_us))
    inside = Window.partitionBy(*CELL, "_d").orderBy("t", "event_id")
    lagged = rows.withColumn("_b", F.lag(F.struct("asset_hash")).over(inside))
    ends = rows.groupBy(*CELL, "_d").agg(F.max_by(F.struct("asset_hash"), F.struct("t", "event_id")).alias("_e"))
    carried = ends.select(*CELL, "_d", F.lag("_e").over(Window.partitionBy(*CELL).orderBy("_d")).alias("_e"))
    met = lagged.join(carried, [*CELL, "_d"]).withColumn("_b", F.coalesce("_b", "_e")["asset_hash"])
    return met.filter("_b is null or _b <> asset_hash").select(*log.columns)


def pointer(log: DataFrame, at: int) -> DataFrame:
    """(monitor_id, x, y, asset_hash) of the newest pointer entry of each monitor; hash 0 is hidden."""
    last = log.filter((F.col("op") == 4) & (F.col("t") <= at)).groupBy("monitor_id").agg(F.max_by(F.struct("tile_x", "tile_y", "asset_hash"), F.struct("t", "event_id")).alias("p"))
    return last.select("monitor_id", F.col("p.tile_x").alias("x"), F.col("p.tile_y").alias("y"), F.col("p.asset_hash").alias("asset_hash"))


SLICE = 86_400_000_000  # µs; as-of windows run over slices of a day, so that no key is one task


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str, slice_us: int = SLICE) -> DataFrame:
    """left with the latest non-null ``value`` of right at or before its ``on`` and equal ``by``; ties take the larger value.

    A union and a window inside each slice of time; a slice's last value is carried to later slices through a table of
    one row for each key and slice, so a hot key spreads over as many tasks as it has slices.
    """
    a = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_s": F.lit(1), "_row": F.struct(*left.columns)})
    b = right.select(*by, on, F.col(value).alias("_v"), F.lit(0).alias("_s"))
    cut = F.floor(F.col(on) / slice_us).alias("_d")
    both = a.select(*by, on, "_v", "_s", "_row", cut).unionByName(b.select("*", cut), allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_d").orderBy(on, "_s", F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).filter("_s = 1")
    slices = both.groupBy(*by, "_d").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(on, "_v"))).alias("_v"))
    earlier = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*by, "_d", F.last("_v", ignorenulls=True).over(earlier).alias("_before"))
    return rows.join(carried, [*by, "_d"], "left").select("_row.*", F.coalesce("_v", "_before").alias(value))


def folds(log: DataFrame, points: DataFrame) -> DataFrame:
    """(monitor_id, at, tile_x, tile_y, asset_hash): the fold at many points (monitor_id, at), such as a film's frames.

    An as-of search for each cell of each point, so entries are read once whatever the number of points; the result has
    a row for each filled cell of each frame.
    """
    tiles = log.filter("op <= 2").select(*CELL, "t", F.struct("event_id", F.when(F.col("op") != 2, F.col("asset_hash")).alias("asset_hash")).alias("last"))
    asked = points.select("monitor_id", F.col("at").alias("t")).distinct().join(tiles.select(*CELL).distinct(), "monitor_id")
    found = asof(asked, tiles, "t", list(CELL), "last").filter("last.asset_hash is not null")
    return found.select("monitor_id", F.col("t").alias("at"), "tile_x", "tile_y", F.col("last.asset_hash").alias("asset_hash"))


LOWEST = -(1 << 63)


def arrivals(log: DataFrame, points: DataFrame, slice_us: int = 3_600_000_000) -> DataFrame:
    """(monitor_id, at, base, tile_x, tile_y, asset_hash): what changed on the way to each point (monitor_id, at, base).

    An entry belongs to the first point at or after it, if it came after that point's base; the last one of each cell
    counts, null where it clears the cell. A partial aggregate follows the search, so a row for each changed cell and
    point goes on, however often the cell changed between two points.
    """
    p = F.struct("at", "base").alias("p")
    right = points.select("monitor_id", (-F.col("at")).alias("n"), p)
    rows = log.filter("op <= 2").select("event_id", *CELL, "t", (-F.col("t")).alias("n"), F.struct(F.when(F.col("op") != 2, F.col("asset_hash")).alias("asset_hash")).alias("last"))
    met = asof(rows, right, "n", ["monitor_id"], "p", slice_us).filter("p is not null and t > p.base")
    last = met.groupBy("monitor_id", "p", "tile_x", "tile_y").agg(F.max_by("last", F.struct("t", "event_id")).alias("last"))
    return last.select("monitor_id", "p.at", "p.base", "tile_x", "tile_y", "last.asset_hash")


def folds_since(log: DataFrame, points: DataFrame, times: DataFrame, tiles: DataFrame | None, slice_us: int = 3_600_000_000) -> DataFrame:
    """``folds`` from snapshots: each point starts from the newest snapshot at or before it and reads the entries since.

    ``times`` (at) are the snapshots' instants and ``tiles`` (at, cell, asset_hash) their filled cells. Points that share
    a snapshot share one delta; no entry before the first snapshot used is needed. A point before every snapshot reads
    the log from its start.
    """
    asked = points.select("monitor_id", F.col("at").alias("t")).distinct()
    known = times.select(F.col("at").alias("t"), F.col("at").alias("base"))
    known = known.join(asked.select("monitor_id").distinct())  # a row for each monitor and snapshot
    asked = asof(asked, known, "t", ["monitor_id"], "base", slice_us).withColumn("base", F.coalesce("base", F.lit(LOWEST)))
    content = F.struct("asset_hash").alias("last")
    cells = arrivals(log, asked.withColumnRenamed("t", "at"), slice_us).select("base", *CELL, F.col("at").alias("t"), content)
    if tiles is not None:
        first = tiles.select(F.col("at").cast("long").alias("base"), *CELL, F.col("at").cast("long").alias("t"), content)
        cells = first.join(asked.select("monitor_id", "base").distinct(), ["monitor_id", "base"], "left_semi").select(cells.columns).unionByName(cells)
    by = ["base", *CELL]
    found = asof(asked.join(cells.select(*by).distinct(), ["monitor_id", "base"]), cells, "t", by, "last", slice_us).filter("last.asset_hash is not null")
    return found.select("monitor_id", F.col("t").alias("at"), "tile_x", "tile_y", F.col("last.asset_hash").alias("asset_hash"))


def in_force(geometry: DataFrame) -> DataFrame:
    """Which row of ``geometry`` (monitor_id, first_t, last_t, row and more) holds from from_t until before until_t.

    The covering interval with the latest first_t (then the first row), else, among those begun, the one with the
    latest last_t (then the last row). That changes only where an interval begins or has ended, so the rule is settled
    on the dimension alone; it has a row for each geometry that a monitor ever had.
    """
    ends = F.explode(F.array(F.col("first_t"), F.col("last_t") + 1)).alias("from_t")
    points = geometry.select("monitor_id", ends).distinct()
    begun = points.join(geometry.select("monitor_id", F.struct(*[c for c in geometry.columns if c != "monitor_id"]).alias("g")), "monitor_id").filter("g.first_t <= from_t")
    covers = F.col("from_t") <= F.col("g.last_t")
    rank = F.struct(covers, F.when(covers, F.col("g.first_t")).otherwise(F.col("g.last_t")), F.when(covers, -F.col("g.row")).otherwise(F.col("g.row")))
    best = begun.groupBy("monitor_id", "from_t").agg(F.max_by("g", rank).alias("g"))
    until = F.lead("from_t", 1, (1 << 63) - 1).over(Window.partitionBy("monitor_id").orderBy("from_t"))
    return best.withColumn("until_t", until)


#: Rows of a dimension up to which it is broadcast.
SENT = 10_000


def few(rows: DataFrame) -> bool:
    """Whether a dimension may be broadcast: one count over a limit tells."""
    return rows.limit(SENT + 1).count() <= SENT


def small(rows: DataFrame) -> DataFrame:
    """rows, marked to be broadcast if they are few; beyond that the join is left to shuffle, where adaptive execution
    splits a hot monitor."""
    return F.broadcast(rows) if few(rows) else rows


def _under(log: DataFrame, stretches: DataFrame) -> DataFrame:
    """log with the stretch (from_t, g) it falls in; nulls before the first. One match at most, so nothing multiplies.

    A monitor's stretches follow one another without a hole, so where they are too many to be broadcast an as-of search
    for the last one begun finds the same.
    """
    if not few(stretches):
        begun = stretches.select("monitor_id", F.col("from_t").alias("t"), F.struct("from_t", "g").alias("_st"))
        return asof(log, begun, "t", ["monitor_id"], "_st").select(*log.columns, "_st.from_t", "_st.g")
    s = F.broadcast(stretches.select(F.col("monitor_id").alias("_m"), "from_t", "until_t", "g"))
    met = (F.col("monitor_id") == F.col("_m")) & (F.col("from_t") <= F.col("t")) & (F.col("t") < F.col("until_t"))
    return log.join(s, met, "left").drop("_m", "until_t")


def geometry_at(log: DataFrame, geometry: DataFrame) -> DataFrame:
    """(event_id, grid): geometry in force at each entry, null before a monitor's first."""
    return _under(log, in_force(geometry)).select("event_id", F.col("g.grid").alias("grid"))


def monitors_at(geometry: DataFrame, at: int) -> DataFrame:
    """All monitors that had begun at an instant, a row each, with the geometry in force then."""
    now = in_force(geometry).filter((F.col("from_t") <= at) & (F.col("until_t") > at))
    return now.select("monitor_id", "g.*")


def replay(log: DataFrame, geometry: DataFrame, at: int, base: DataFrame | None = None) -> DataFrame:
    """(monitor_id, idx, asset_hash): the fold at ``at`` on grids that change while the log runs.

    ``geometry`` has monitor_id, columns, rows, origin_x, origin_y (cells), first_t, last_t, row. A monitor starts on the
    grid in force at ``at`` (its newest if none is). Each entry but a pointer's, heartbeats included, puts its monitor on
    the grid in force then; a change of columns or rows empties it, a move of the origin keeps cells by index. Cells
    outside the grid and monitors without geometry are left out. ``base`` (monitor_id, columns, rows, idx, asset_hash)
    gives untouched cells where no change emptied the monitor and the grids agree.

    Changes are found on the stretches that hold an entry, a few rows for each monitor, never by a window over the log.
    """
    stretches = in_force(geometry)
    newest = geometry.groupBy("monitor_id").agg(F.max_by(F.struct(*[c for c in geometry.columns if c != "monitor_id"]), F.struct("last_t", "row")).alias("newest"))
    now = stretches.filter((F.col("from_t") <= at) & (F.col("until_t") > at)).select("monitor_id", "g")
    seed = newest.join(now, "monitor_id", "left").select("monitor_id", F.coalesce("g", "newest").alias("seed"))
    rows = _under(log.filter((F.col("op") != 4) & (F.col("t") <= at)), stretches)
    grid = lambda g: F.struct(F.col(f"{g}.columns").alias("columns"), F.col(f"{g}.rows").alias("rows"))
    synced = rows.filter("g is not null").select("monitor_id", "from_t", grid("g").alias("grid")).distinct()
    held = synced.unionByName(seed.select("monitor_id", F.lit(-(1 << 63)).alias("from_t"), grid("seed").alias("grid")))
    before = F.lag("grid").over(Window.partitionBy("monitor_id").orderBy("from_t"))
    emptied = held.withColumn("before", before).filter("before <> grid").groupBy("monitor_id").agg(F.max("from_t").alias("since"))
    monitors = seed.join(emptied, "monitor_id", "left")
    entries = rows.filter("op <= 2").join(small(monitors), "monitor_id").filter("since is null or t >= since").withColumn("g", F.coalesce("g", "seed"))
    x, y = F.col("tile_x") - F.col("g.origin_x"), F.col("tile_y") - F.col("g.origin_y")
    inside = x.between(0, F.col("g.columns") - 1) & y.between(0, F.col("g.rows") - 1)
    cells = entries.filter(inside).withColumn("idx", (y * F.col("g.columns") + x).cast("long"))
    last = cells.groupBy("monitor_id", "idx").agg(F.max_by(F.struct("op", "asset_hash"), F.struct("t", "event_id")).alias("last"))
    found = last.select("monitor_id", "idx", F.when(F.col("last.op") != 2, F.col("last.asset_hash")).alias("asset_hash"))
    if base is not None:
        fits = base.join(monitors.filter("since is null"), "monitor_id").filter((F.col("columns") == F.col("seed.columns")) & (F.col("rows") == F.col("seed.rows")))
        old = fits.select("monitor_id", F.col("idx").cast("long").alias("idx"), "asset_hash").join(found.select("monitor_id", "idx"), ["monitor_id", "idx"], "left_anti")
        found = found.unionByName(old)
    return found.filter("asset_hash is not null")


def deltas(log: DataFrame, step_us: int = 180_000_000) -> DataFrame:
    """(step, cell, op, asset_hash): last tile operation of each cell in each step of time, the increments of periodic
    snapshots; a snapshot at a step's end is the fold of the increments up to it."""
    step = F.floor(F.col("t") / step_us).alias("step")
    last = log.filter("op <= 2").groupBy(step, *CELL).agg(F.max_by(F.struct("op", "asset_hash"), F.struct("t", "event_id")).alias("last"))
    return last.select("step", *CELL, "last.op", "last.asset_hash")


def sampled(log: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """(instant, last_t): fixed-step instants and the newest entry at or before each."""
    points = log.sparkSession.range(max(1, (end - start) // step)).select((F.lit(start) + F.col("id") * step).alias("t"), F.lit(0).alias("_k"))
    rows = log.filter(F.col("t") <= end).select("t", F.lit(0).alias("_k"), F.col("t").alias("last_t"))
    return asof(points, rows, "t", ["_k"], "last_t").select(F.col("t").alias("instant"), "last_t")


def stepped(log: DataFrame, at: int, monitors: list[int] | None = None) -> DataFrame:
    """One row: newest entry before ``at``, newest at or before it, and next after it."""
    rows = log if monitors is None else log.filter(F.col("monitor_id").isin(*monitors))
    t = F.col("t")
    return rows.agg(F.max(F.when(t < at, t)).alias("previous_t"), F.max(F.when(t <= at, t)).alias("at_t"), F.min(F.when(t > at, t)).alias("next_t"))


def played(elapsed_us, speed, anchor: int, start: int, end: int):
    """Playhead position of a clock: anchor + elapsed * speed within the bounds; speed between 0.05 and 64."""
    moved = (F.lit(anchor) + elapsed_us * F.greatest(F.lit(0.05), F.least(F.lit(64.0), speed))).cast("long")
    return F.greatest(F.lit(start), F.least(F.lit(end), moved))
