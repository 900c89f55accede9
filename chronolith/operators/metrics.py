"""Status metrics: counter deltas, rates, moving averages, growth and verdicts of a run."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(samples: DataFrame, by: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """Last minus first of each counter in a phase; a group is one partial aggregate."""
    at = F.struct(*order)
    return samples.groupBy(*by).agg(*[(F.max_by(c, at) - F.min_by(c, at)).alias(c) for c in counters])


def skipped_percent(hashed: Column, stored: Column) -> Column:
    """Share of hashed tiles that needed no storing; none hashed: 100."""
    return F.when(hashed == 0, F.lit(100.0)).otherwise(100.0 * (hashed - stored) / hashed)


def run_summary(runs: DataFrame) -> DataFrame:
    """Rates of runs (seconds, tiles_hashed, tiles_deduped, log_entries, bytes_written): a second at least is counted."""
    s = F.greatest(F.lit(1.0), F.col("seconds").cast("double"))
    share = F.when(F.col("tiles_hashed") == 0, F.lit(0.0)).otherwise(100.0 * F.col("tiles_deduped") / F.col("tiles_hashed"))
    return runs.withColumns({"tiles_per_s": F.col("tiles_hashed") / s, "dedupe_percent": share, "entries_per_s": F.col("log_entries") / s, "bytes_per_hour": F.col("bytes_written") / s * 3600})


def cpu_percent(samples: DataFrame, by: list[str], cores: int) -> DataFrame:
    """Samples (t_ms, cpu_ms) with the processor share since the one before; 0 where at most 100 ms went by."""
    w = Window.partitionBy(*by).orderBy("t_ms", "cpu_ms")
    went, used = F.col("t_ms") - F.lag("t_ms").over(w), F.col("cpu_ms") - F.lag("cpu_ms").over(w)
    return samples.withColumn("cpu_percent", F.when(went > 100, 100.0 * used / (went * cores)).otherwise(0.0))


def moving_average(rows: DataFrame, by: list[str], order: list[str], value: str, weight: float = 0.2) -> DataFrame:
    """(by, average): exponential average, begun with the first value; each next one counts ``weight``.

    The sum of values by powers of 1 - weight, so after one sort it is an ordinary partial aggregate and no group is
    gathered. Nulls are left out.
    """
    rows = rows.filter(F.col(value).isNotNull())
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])) - 1
    oldest = F.lead(value).over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])).isNull()
    share = F.pow(F.lit(1 - weight), newest) * F.when(oldest, 1.0).otherwise(weight)
    return rows.select(*by, (F.col(value) * share).alias("_v")).groupBy(*by).agg(F.sum("_v").alias("average"))


def growth(samples: DataFrame, by: list[str]) -> DataFrame:
    """What a long run's samples (seconds, cpu, memory, handles) say; fewer than two give no row.

    Growth counts from the second of four or more samples, the average of cpu from the second. Handles are judged by the
    lowest of each half, so that waves are no growth. Shrinking is no growth; a hundredth of an hour at least is counted.
    """
    w = Window.partitionBy(*by)
    ordered = samples.withColumns({"i": F.row_number().over(w.orderBy("seconds")) - 1, "n": F.count("*").over(w)}).filter("n > 1")
    start = F.when(F.col("n") >= 4, 1).otherwise(0)
    middle = F.greatest(start + 1, F.floor(F.col("n") / 2))
    r = ordered.withColumns({"start": start, "middle": middle})
    i, n = F.col("i"), F.col("n")

    def at(c: str, where: Column) -> Column:
        return F.max(F.when(where, F.col(c)))

    found = r.groupBy(*by).agg(
        F.count("*").alias("samples"), F.avg(F.when(i >= 1, F.col("cpu"))).alias("cpu_average"),
        at("seconds", i == F.col("start")).alias("s0"), at("seconds", i == F.col("middle")).alias("s1"), at("seconds", i == n - 1).alias("s2"),
        at("memory", i == F.col("start")).alias("m0"), at("memory", i == n - 1).alias("m2"),
        F.min(F.when((i >= F.col("start")) & (i < F.col("middle")), F.col("handles"))).alias("early_floor"),
        F.min(F.when(i >= F.col("middle"), F.col("handles"))).alias("late_floor"), F.max(F.when(i >= F.col("middle"), F.col("handles"))).alias("late_peak"),
    )

    def rate(first: str, last: str, since: str) -> Column:
        return F.greatest(F.lit(0.0), (F.col(last) - F.col(first)).cast("double")) / F.greatest(F.lit(0.01), (F.col("s2") - F.col(since)) / 3600.0)

    return found.select(*by, "samples", "cpu_average", "early_floor", "late_floor", "late_peak", rate("m0", "m2", "s0").alias("memory_per_hour"), rate("early_floor", "late_floor", "s1").alias("handles_per_hour"))


def verdict(valid: Column, *gates: Column) -> Column:
    """INVALID where nothing worth judging was measured, else PASS if all gates hold (null does not), else FAIL."""
    passed = F.lit(True)
    for g in gates:
        passed = passed & F.coalesce(g, F.lit(False))
    return F.when(~F.coalesce(valid, F.lit(False)), "INVALID").when(passed, "PASS").otherwise("FAIL")


def pace_ms(cost_ms: Column, cores: int, level: Column, least: float, most: float, percent: float = 1.0) -> Column:
    """Milliseconds between turns of a loop that may use ``percent`` of the cores, longer at higher throttle levels."""
    return F.greatest(F.lit(least), F.least(F.lit(most), 1000.0 * cost_ms / (percent / 100 * cores * 1000) * (1 + 0.5 * level)))


def timeout_ms(idle_frames: Column, most: int) -> Column:
    """How long to wait for a frame after so many idle ones: doubling from 15 ms."""
    return F.least(F.lit(most), 15 * F.pow(F.lit(2), F.least(idle_frames, F.lit(6)))).cast("long")
