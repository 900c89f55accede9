"""Content and maintenance: dedupe, references, garbage, purge, trim, budgets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content(docs: DataFrame) -> DataFrame:
    """(asset, first_id, refs): each distinct content once."""
    return docs.groupBy(F.md5("text").alias("asset")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("refs"))


def references(log: DataFrame) -> DataFrame:
    """(asset_hash, first_t, refs): when each asset was first named, and how often; hash 0 names nothing."""
    return log.filter("asset_hash <> 0").groupBy("asset_hash").agg(F.min("t").alias("first_t"), F.count("*").alias("refs"))


def unseen(new: DataFrame, stored: DataFrame, key: str = "asset") -> DataFrame:
    """Assets to store: one row for each key that the store lacks."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def garbage(assets: DataFrame, *references: DataFrame) -> DataFrame:
    """Assets that none of the references (each with column asset) names."""
    for r in references:
        assets = assets.join(r.select("asset"), "asset", "left_anti")
    return assets


def purge(log: DataFrame, start: int, end: int) -> DataFrame:
    """Log without the closed range; references must be worked out again from what is left."""
    return log.filter(~F.col("t").between(start, end))


def trim(spans: DataFrame, at: int) -> DataFrame:
    return spans.filter(F.col("start_t") < at).withColumn("end_t", F.least("end_t", F.lit(at)))


def subtract(spans: DataFrame, start: int, end: int) -> DataFrame:
    """Spans without the closed range [start, end]: up to two pieces each."""
    pieces = F.array(F.struct(F.col("start_t").alias("a"), F.least("end_t", F.lit(start)).alias("b")), F.struct(F.greatest("start_t", F.lit(end)).alias("a"), F.col("end_t").alias("b")))
    cut = spans.withColumn("p", F.explode(F.filter(pieces, lambda p: p["a"] < p["b"])))
    return cut.withColumns({"start_t": F.col("p.a"), "end_t": F.col("p.b")}).drop("p")


def retained(days: DataFrame, today, n: int) -> DataFrame:
    """Rows of day >= today - max(1, n): a filter on the partition column."""
    return days.filter(F.col("day") >= F.date_sub(F.lit(today).cast("date"), max(1, n)))


def newest(rows: DataFrame, order: str, size: str, count: int, budget: int) -> DataFrame:
    """The newest rows within a count and a running total of sizes. ``count`` rows at most are ordered in one task."""
    top = rows.orderBy(F.desc(order)).limit(count)
    total = F.sum(size).over(Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("total", total).filter(F.col("total") <= budget)


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records (pack, n, ok) of each pack before its first bad one."""
    bad = records.filter(~F.col("ok")).groupBy("pack").agg(F.min("n").alias("bad"))
    return records.join(bad, "pack", "left").filter("bad is null or n < bad").drop("bad")


def budget_level(rows: DataFrame, day: str, order: list[str], size: str, budget: int, slice_width: int | None = None) -> DataFrame:
    """Running bytes of a day and its level: 0 within the budget, 1 above it, 2 (paused) above twice.

    Sums run inside slices of ``slice_width`` of the first order column, a number, and start from the slices before, which
    are summed over a row a slice; so a busy day is no single task. Without a width a day is one slice.
    """
    cut = F.lit(0) if slice_width is None else F.floor(F.col(order[0]) / slice_width)
    rows = rows.withColumn("_s", cut.cast("long"))
    inside = F.sum(size).over(Window.partitionBy(day, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy(F.col(day).alias("_day"), F.col("_s").alias("_slice")).agg(F.sum(size).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("_day").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select("_day", "_slice", earlier.alias("_before"))
    met = rows.withColumn("used", inside).join(carried, F.col(day).eqNullSafe(F.col("_day")) & F.col("_s").eqNullSafe(F.col("_slice")))
    met = met.withColumn("used", F.col("used") + F.coalesce("_before", F.lit(0))).drop("_s", "_day", "_slice", "_before")
    return met.withColumn("level", F.when(F.col("used") > 2 * budget, 2).when(F.col("used") > budget, 1).otherwise(0))


def old_garbage(assets: DataFrame, now_ms: int, grace_ms: int, *references: DataFrame) -> DataFrame:
    """Garbage whose file (mtime_ms) has outlived the grace: content may be stored before the entry that names it."""
    return garbage(assets.filter(F.col("mtime_ms") <= now_ms - grace_ms), *references)


def empty_packs(index: DataFrame, removed: DataFrame) -> DataFrame:
    """(pack) whose assets (pack, asset) are all removed; the newest pack may still be written and stays."""
    live = index.join(removed.select("asset").distinct().withColumn("_gone", F.lit(1)), "asset", "left")
    newest = index.agg(F.max("pack").alias("_newest"))
    dead = live.groupBy("pack").agg(F.count_if(F.col("_gone").isNull()).alias("live")).filter("live = 0")
    return dead.crossJoin(newest).filter("pack < _newest").select("pack")  # the newest pack is one row


def stored(packed: DataFrame, single: DataFrame) -> DataFrame:
    """Every asset once, with the place it is read from: a file of its own hides the packed copy."""
    both = packed.withColumn("_p", F.lit(1)).unionByName(single.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    rest = F.struct(*[c for c in both.columns if c not in ("asset", "_p")])
    return both.groupBy("asset").agg(F.min_by(rest, "_p").alias("r")).select("asset", "r.*")


def store_stats(assets: DataFrame) -> DataFrame:
    return assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def purge_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(day, removed): entries that a purge took from each day it touched."""
    n = before.groupBy("day").agg(F.count("*").alias("a")).join(after.groupBy("day").agg(F.count("*").alias("b")), "day", "left")
    return n.select("day", (F.col("a") - F.coalesce("b", F.lit(0))).alias("removed")).filter("removed > 0")


def unsigned(h):
    """Sort key of hashes as unsigned numbers."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))
