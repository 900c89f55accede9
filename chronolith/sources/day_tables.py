"""A recording as Parquet tables partitioned by day: writers, and reads that touch only what they ask for.

The log is laid out in order of time, so a range of time prunes days by partition and row groups by the bounds of t.
"""

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import state, store
from chronolith.sources.folders import Folder

FIELDS = ("t", "window_id", "monitor_id", "tile_x", "tile_y", "asset_hash", "op")


def append_log(log: DataFrame, path: str) -> None:
    """Adds entries to the table of the log; entries whose fields are all zero are dropped."""
    filled = log.filter(" or ".join(f"{c} <> 0" for c in FIELDS))
    filled.repartitionByRange("day", "t").sortWithinPartitions("day", "t", "event_id").write.partitionBy("day").mode("append").parquet(path)


def log_between(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Entries of a closed range of time (µs). Days are cut with a day to spare, as they may be those of any time zone."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.filter((F.col("day") >= F.date_sub(F.timestamp_micros(F.lit(start)), 1)) & (F.col("t") >= start))
    if end is not None:
        rows = rows.filter((F.col("day") <= F.date_add(F.timestamp_micros(F.lit(end)), 1)) & (F.col("t") <= end))
    return rows


def write_snapshots(tiles: DataFrame, path: str) -> None:
    """Stores snapshots (day, at in µs, cell, asset_hash), a partition each: one that is written again replaces itself."""
    tiles.repartition("day", "at").write.partitionBy("day", "at").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _listed(spark: SparkSession, path: str, until: int | None = None) -> list[tuple]:
    """(day, at) of the snapshots up to an instant, from the partitions' names alone; days may be those of any time zone."""
    folder, found = Folder(spark, path), []
    for day, name in folder.days().items():
        if until is None or day <= date(1970, 1, 1) + timedelta(days=until // 86_400_000_000 + 1):
            found += [(day, int(n[3:])) for n in folder.names(name) if re.fullmatch(r"at=-?\d+", n)]
    return sorted(x for x in found if until is None or x[1] <= until)


def snapshot_times(spark: SparkSession, path: str) -> DataFrame:
    """(day, at) of all snapshots, from the partitions' names alone."""
    return spark.createDataFrame(_listed(spark, path), "day date, at long")


def newest_snapshot(spark: SparkSession, path: str, at: int) -> tuple[DataFrame | None, int | None]:
    """The cells of the newest snapshot at or before an instant, and its time; two Nones if there is none."""
    found = max((t for _, t in _listed(spark, path, at)), default=None)
    return (None, None) if found is None else (spark.read.parquet(path).filter(F.col("at") == found), found)


def state_at(spark: SparkSession, log_path: str, snapshots_path: str, at: int) -> DataFrame:
    """The state at an instant from the newest snapshot before it and the entries since."""
    base, base_t = newest_snapshot(spark, snapshots_path, at)
    return state.fold(log_between(spark, log_path, base_t, at), at, base, base_t)


def states_at(spark: SparkSession, log_path: str, snapshots_path: str, points: DataFrame) -> DataFrame:
    """The states at many points (monitor_id, at), each from the newest snapshot before it, see ``state.folds_since``.

    Days of the log before the first of those snapshots, and after the last point, are not read.
    """
    first, last = points.agg(F.min("at"), F.max("at")).first()
    times = [] if last is None else [t for _, t in _listed(spark, snapshots_path, last)]
    begin = max((t for t in times if t <= first), default=None)
    times = [t for t in times if begin is None or t >= begin]
    tiles = spark.read.parquet(snapshots_path).filter(F.col("at").between(times[0], times[-1])) if times else None
    return state.folds_since(log_between(spark, log_path, begin, last), points, spark.createDataFrame([(t,) for t in times], "at long"), tiles)


def append_assets(new: DataFrame, path: str, key: str = "asset_hash") -> None:
    """Adds the assets that the table lacks, one row a key; a table that isn't there yet is begun."""
    spark = new.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    rows = store.unseen(new, spark.read.parquet(path), key) if there else new.dropDuplicates([key])
    rows.write.mode("append").parquet(path)
