"""Fidelity and integrity: frame differences and missing references."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_diff(frames: DataFrame, key: str, a: str, b: str, tolerance: float) -> DataFrame:
    """(key, mismatches, max_delta, first_bad, last_bad): elements of two arrays that differ by more than tolerance."""
    delta = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    bad = F.filter(F.transform("delta", lambda d, i: F.when(d > tolerance, i)), lambda i: i.isNotNull())
    rows = frames.withColumn("delta", delta).withColumn("bad", bad)
    return rows.select(key, F.size("bad").alias("mismatches"), F.array_max("delta").alias("max_delta"), F.array_min("bad").alias("first_bad"), F.array_max("bad").alias("last_bad"), F.size("delta").alias("elements"))


def fidelity(diffs: DataFrame, key: str) -> DataFrame:
    """One row: frames, exact ones, ratio over all elements, mean ratio of frames, the worst frame."""
    ratio = 1 - F.col("mismatches") / F.col("elements")
    return diffs.agg(
        F.count("*").alias("frames"), F.sum((F.col("mismatches") == 0).cast("long")).alias("exact"), (1 - F.sum("mismatches") / F.sum("elements")).alias("pixel_ratio"),
        F.avg(ratio).alias("mean_ratio"), F.min(ratio).alias("worst"), F.min_by(key, F.struct(ratio, F.col(key))).alias("worst_at"),
    )


def integrity(referenced: DataFrame, assets: DataFrame, examples: int = 5) -> DataFrame:
    """One row: distinct references, present and missing, and the first missing by value."""
    seen = referenced.select("asset").distinct().join(assets.select("asset", F.lit(1).alias("there")).distinct(), "asset", "left")
    totals = seen.agg(F.count("*").alias("referenced"), F.count("there").alias("present"), F.count_if(F.col("there").isNull()).alias("missing"))
    first = seen.filter("there is null").orderBy("asset").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("asset")), ",").alias("examples"))
    return totals.join(first)


def report(log: DataFrame, tiles: DataFrame, assets: DataFrame, examples: int = 5) -> DataFrame:
    """One row: entries, distinct assets that tile entries or snapshots (``tiles``) name, how many of those are present,
    missing and corrupt (``assets`` has asset_hash, ok), and the first ones missing or corrupt. Hash 0 names nothing."""
    named = log.filter("op <= 1").select("asset_hash").union(tiles.select("asset_hash")).filter("asset_hash <> 0").distinct()
    whole = assets.groupBy("asset_hash").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok"))
    met = named.join(whole, "asset_hash", "left")
    counts = met.agg(F.count("*").alias("referenced"), F.count_if(F.col("ok")).alias("present"), F.count_if(F.col("ok").isNull()).alias("missing"), F.count_if(~F.col("ok")).alias("corrupt"))
    first = met.filter("ok is null or not ok").orderBy("asset_hash").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("asset_hash")), ",").alias("examples"))
    return log.agg(F.count("*").alias("entries")).join(counts).join(first)  # one row each
