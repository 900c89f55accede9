"""Stream sinks that keep one copy of each asset, and index tables merged a day at a time, exactly once.

A batch writes under its own number, so that a batch which runs again replaces what it had written. Assets come before
the entries that name them: whoever reads an entry finds its asset.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import timeline
from chronolith.sources import maintenance


class Seen:
    """Keys known to be stored, in two generations of bounded size: when the young one is full the old one is forgotten.

    Only what is in the store may be put in. A key that isn't here is looked up there, so forgetting costs time alone.
    """

    def __init__(self, capacity: int = 262_144):
        self.half = max(1, capacity // 2)
        self.young = self.old = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def __contains__(self, key: int) -> bool:
        return bool(np.isin(key, self.young) or np.isin(key, self.old))

    def add(self, keys: np.ndarray) -> None:
        keys = np.setdiff1d(keys, self.young)
        for at in range(0, len(keys), self.half):
            some = keys[at : at + self.half]
            if len(self.young) + len(some) > self.half:
                self.old, self.young = self.young, some
            else:
                self.young = np.union1d(self.young, some)

    def frame(self, spark: SparkSession, key: str) -> DataFrame:
        keys = np.union1d(self.young, self.old)
        return spark.createDataFrame(pa.table({f"_{key}": pa.array(keys)}))


class Store:
    """Assets and entries of a stream as Parquet tables: ``assets/batch=n`` and ``log/batch=n/day=...``."""

    def __init__(self, spark: SparkSession, assets: str, log: str, key: str = "asset_hash", payload: tuple[str, ...] = ("payload",), capacity: int = 262_144):
        self.spark, self.assets, self.log, self.key, self.payload = spark, assets, log, key, payload
        self.seen, self.probes = Seen(capacity), 0

    def seed(self, named: DataFrame) -> None:
        """Puts hashes that are stored (such as those of the last days' entries) in front, as many as there is room for."""
        self.seen.add(self._keys(named.limit(2 * self.seen.half)))

    def _keys(self, rows: DataFrame) -> np.ndarray:
        return np.array(rows.select(F.col(self.key).cast("long").alias("k")).distinct().toPandas()["k"], np.int64)

    def _before(self, n: int) -> DataFrame | None:
        """Keys that batches before ``n`` stored, as the store is now."""
        if not any(m.startswith("batch=") for m in maintenance.Folder(self.spark, self.assets).names()):
            return None
        return self.spark.read.parquet(self.assets).filter(F.col("batch") < n).select(F.col(self.key).alias("_stored"))

    def write(self, batch: DataFrame, n: int) -> None:
        """Stores a micro-batch: assets that no batch before it has, one row a key (0 and null name nothing), then its entries.

        The seen keys are broadcast (their number is bounded); only where some key isn't among them the store is read.
        """
        batch = batch.persist()
        try:
            fresh = batch.filter(F.col(self.key) != 0).select(self.key, *self.payload).dropDuplicates([self.key])
            if len(self.seen):
                fresh = fresh.join(F.broadcast(self.seen.frame(self.spark, self.key)), F.col(self.key) == F.col(f"_{self.key}"), "left_anti")
            fresh = fresh.persist()
            if not fresh.isEmpty():
                stored = self._before(n)
                self.probes += 1
                new = fresh if stored is None else fresh.join(stored, F.col(self.key) == F.col("_stored"), "left_anti")
                new.write.mode("overwrite").parquet(f"{self.assets}/batch={n}")
            entries = batch.drop(*self.payload)
            if "day" not in entries.columns:
                entries = entries.withColumn("day", F.to_date(F.timestamp_micros("t")))
            entries.write.mode("overwrite").partitionBy("day").parquet(f"{self.log}/batch={n}")
            self.seen.add(self._keys(fresh.limit(2 * self.seen.half)))
            fresh.unpersist()
        finally:
            batch.unpersist()


def store(stream: DataFrame, assets: str, log: str, checkpoint: str, trigger: dict | None = None, **options):
    """Starts a query that stores a stream of entries (t, asset_hash, payload, ...) with one copy of each asset, whatever
    restarts and late repeats. One query may write to a store at a time; ``options`` are those of ``Store``."""
    kept = Store(stream.sparkSession, assets, log, **options)
    return stream.writeStream.foreachBatch(kept.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merge_days(spark: SparkSession, path: str, n: int, new: DataFrame, merge) -> list[date]:
    """Merges a batch's rows (day, ...) into a table by day: ``merge(stored, new)`` gives what the touched days shall hold.

    Each day keeps the number of the last batch merged into it, so a batch that runs again changes nothing where it has
    been already. Only touched days are read and written, through a plan that a cut-off merge is ended by.
    """
    maintenance.recover(spark, path)
    there = set(maintenance.Folder(spark, path).days())
    new = new.persist()
    try:
        days = sorted(r.day for r in new.select("day").distinct().collect())
        held = [d for d in days if d in there]
        stored = spark.read.parquet(path).filter(F.col("day").isin(held)) if held else None
        if stored is not None:
            done = {r.day for r in stored.groupBy("day").agg(F.max("batch").alias("n")).filter(F.col("n") >= n).collect()}
            days = [d for d in days if d not in done]
            stored = stored.filter(F.col("day").isin(days)).drop("batch")
        if days:
            rows = new.filter(F.col("day").isin(days))
            if stored is None:
                stored = spark.createDataFrame([], rows.schema)
            merged = merge(stored.select(rows.columns), rows).withColumn("batch", F.lit(n).cast("long"))
            maintenance.rewrite_days(spark, path, days, merged, "start_ts")
        return days
    finally:
        new.unpersist()


def merge_index(stream: DataFrame, sessions: str, spans: str, checkpoint: str, trigger: dict | None = None, tolerance_ms: int = 2000):
    """Starts a query that keeps two tables by day from a stream of focus spans (day, app, title, start_ts, end_ts): each
    day's session, from its first start to its last end, and its spans, see ``timeline.upserted``. Batches must come in
    order of the spans' starts, as from one writer; then both equal the merge of the whole."""
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        rows = batch.select("day", "start_ts", "end_ts")
        merge_days(spark, sessions, n, timeline.sessions(rows), lambda old, new: timeline.sessions(old.unionByName(new)))
        named = batch.select("day", *(F.coalesce(c, F.lit("")).alias(c) for c in ("app", "title")), "start_ts", "end_ts")
        merge_days(spark, spans, n, named, lambda old, new: timeline.upserted(old, new, tolerance_ms).select(named.columns))
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
