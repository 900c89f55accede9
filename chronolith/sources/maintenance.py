"""Changes to stored recordings: purge, prune and sweeps that touch only the files they must.

Tables partitioned by day are rewritten a day at a time: what a touched day shall hold is written to ``_staged/<job>``
under the table, a plan of the moves is written down, and only then do day folders change places. A job that is killed
before the plan exists has changed nothing; one killed after it is ended by ``recover``. Other days keep their files.
Folders are moved through Hadoop's file systems, so tables may lie wherever Spark reads them; segments of a binary log
are rewritten by tasks that open them with pyarrow. Whoever appends to a table must pause while it is changed.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.operators import store
from chronolith.sources import log_source
from chronolith.sources.binary_log import HEADER, RECORD
from chronolith.sources.day_tables import log_between
from chronolith.sources.folders import Folder, recover
from chronolith.sources.staging import STAGED, Stage, opened


def rewrite_days(spark: SparkSession, path: str, days: list[date], rows: DataFrame, *order: str) -> None:
    """Makes ``rows`` all that the given days of a table hold, laid out by day and ``order``. rows may read the table."""
    if not days:
        return
    folder, job = Folder(spark, path), uuid.uuid4().hex
    staged = f"{STAGED}/{job}/data"
    rows.repartitionByRange("day", *order).sortWithinPartitions("day", *order).write.partitionBy("day").parquet(f"{folder.path}/{staged}")
    there = {n for n in folder.names(staged) if n.startswith("day=")}
    names = [f"day={d}" for d in days]
    if stray := there - set(names):
        raise ValueError(f"rows of days that are not rewritten: {sorted(stray)}")
    folder.commit(job, [(f"{staged}/{n}", n) for n in names if n in there], [n for n in names if n not in there])


def purge_log(spark: SparkSession, path: str, start: int, end: int) -> list[tuple[date, int]]:
    """Takes the entries of a closed range of time (µs) out of a log table; (day, entries taken) of the days touched."""
    inside = log_between(spark, path, start, end)
    touched = sorted((r.day, r["n"]) for r in inside.groupBy("day").agg(F.count("*").alias("n")).collect())
    days = [d for d, _ in touched]
    left = spark.read.parquet(path).filter(F.col("day").isin(days) & ~F.col("t").between(start, end))
    rewrite_days(spark, path, days, left, "t", "event_id")
    return touched


def purge_spans(spark: SparkSession, path: str, start: int, end: int) -> list[date]:
    """Cuts a closed range (in the spans' own unit) out of a table of spans (day, start_t, end_t, ...); the days touched."""
    spans = spark.read.parquet(path)
    met = spans.filter((F.col("start_t") <= end) & (F.col("end_t") >= start))
    days = sorted(r.day for r in met.select("day").distinct().collect())
    rewrite_days(spark, path, days, store.subtract(spans.filter(F.col("day").isin(days)), start, end), "start_t")
    return days


def drop_snapshots(spark: SparkSession, path: str, start: int, end: int) -> list[int]:
    """Drops the snapshots (partitions day, at) of a closed range of time, by their folders' names."""
    folder, gone = Folder(spark, path), []
    for name in folder.days().values():
        for snapshot in folder.names(name):
            if (m := re.fullmatch(r"at=(-?\d+)", snapshot)) and start <= int(m[1]) <= end:
                folder.delete(f"{name}/{snapshot}")
                gone.append(int(m[1]))
    return sorted(gone)


def prune_days(spark: SparkSession, path: str, today: date, keep: int) -> list[date]:
    """Drops a table's days before ``keep`` days (1 at least) ago, by their folders' names; the days dropped."""
    folder, cutoff = Folder(spark, path), today - timedelta(days=max(1, keep))
    old = sorted(d for d in folder.days() if d < cutoff)
    for day in old:
        folder.delete(folder.days()[day])
    return old


def reclaim(spark: SparkSession, path: str, named: DataFrame, now_ms: int, grace_ms: int, key: str = "asset_hash") -> int:
    """Takes the assets that ``named`` (one column, the key) lacks out of a table of Parquet files; how many went.

    Files younger than the grace are left alone, as content may be stored before the entry that names it. Files that
    lose nothing stay as they are, one that loses all is removed, the others are written anew. Assets whose key is null
    are garbage.
    """
    rows = spark.read.parquet(path)
    old = rows.filter(F.unix_millis(F.col("_metadata.file_modification_time")) <= now_ms - grace_ms).select(F.col("_metadata.file_path").alias("_file"), *rows.columns)
    mark = named.select(F.col(named.columns[0]).alias("_named")).distinct()
    gone = old.join(mark, F.col(key) == F.col("_named"), "left_anti").groupBy("_file").agg(F.count("*").alias("n"))
    found = {r["_file"]: r["n"] for r in gone.collect()}  # a row for each file that changes
    if not found:
        return 0
    folder, job = Folder(spark, path), uuid.uuid4().hex
    left = old.filter(F.col("_file").isin(list(found))).join(mark, F.col(key) == F.col("_named"), "left_semi").drop("_file")
    staged = f"{STAGED}/{job}/data"
    left.write.parquet(f"{folder.path}/{staged}")
    moves = [(f"{staged}/{n}", n) for n in folder.names(staged) if n.endswith(".parquet")]
    base = folder.system.makeQualified(folder.at("")).toUri().getPath().rstrip("/")
    removed = [folder.jvm.org.apache.hadoop.fs.Path(f).toUri().getPath().removeprefix(f"{base}/") for f in found]
    folder.commit(job, moves, removed)
    return sum(found.values())


@dataclass(frozen=True)
class Tables:
    """Paths of a recording's tables: log and spans by day, snapshots by day and time, assets; each may be absent."""

    log: str
    snapshots: str | None = None
    spans: str | None = None
    assets: str | None = None

    def named(self, spark: SparkSession) -> DataFrame:
        """Hashes that entries or snapshots name."""
        found = spark.read.parquet(self.log).select("asset_hash")
        if self.snapshots and Folder(spark, self.snapshots).days():
            found = found.union(spark.read.parquet(self.snapshots).select("asset_hash"))
        return found.filter("asset_hash <> 0").distinct()

    def purge(self, spark: SparkSession, start: int, end: int, now_ms: int, grace_ms: int = 120_000) -> dict:
        """Takes a closed range of time (µs; spans are in ms) out of every table, then the assets that only it named.

        References are worked out anew from what is left. Returns what each step did.
        """
        done: dict = {"log": purge_log(spark, self.log, start, end)}
        if self.snapshots:
            done["snapshots"] = drop_snapshots(spark, self.snapshots, start, end)
        if self.spans:
            done["spans"] = purge_spans(spark, self.spans, start // 1000, end // 1000)
        if self.assets:
            done["assets"] = reclaim(spark, self.assets, self.named(spark), now_ms, grace_ms)
        return done

    def prune(self, spark: SparkSession, today: date, keep: int, now_ms: int, grace_ms: int = 1_800_000) -> dict:
        """Drops days from every table that has them, then the assets that only they named."""
        done: dict = {n: prune_days(spark, p, today, keep) for n, p in (("log", self.log), ("snapshots", self.snapshots), ("spans", self.spans)) if p}
        if self.assets:
            done["assets"] = reclaim(spark, self.assets, self.named(spark), now_ms, grace_ms)
        return done


def purge_segments(spark: SparkSession, path: str, magic: bytes, start: int, end: int, glob: str = "log*.bin") -> list[tuple[str, int]]:
    """Takes the entries of a closed range of time out of binary segments; (path, entries taken) of those rewritten.

    A segment is copied by one task, a few MB at a time, and takes its old one's place when all copies are there.
    Segments without such entries are not touched.
    """
    touched = log_source.scan(spark, path, magic, glob=glob).filter(F.col("t").between(start, end)).select("path").distinct()
    stage = Stage(path)

    def copy(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, _ = opened(path)
                to, out = stage.file()
                removed, records = 0, (system.get_file_info(name).size - HEADER) // RECORD.itemsize
                with system.open_input_file(name) as file, out:
                    out.write(file.read_at(HEADER, 0))
                    for at in range(0, records, log_source.BATCH):
                        rows = np.frombuffer(file.read_at(min(log_source.BATCH, records - at) * RECORD.itemsize, HEADER + at * RECORD.itemsize), RECORD)
                        keep = (rows["t"] < start) | (rows["t"] > end)
                        removed += int((~keep).sum())
                        out.write(rows[keep].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([to]), pa.array([removed])], names=["path", "staged", "removed"])

    try:
        copies = touched.mapInArrow(copy, "path string, staged string, removed long").collect()  # a row for each segment
        stage.commit([(r.staged, r.path) for r in copies])
    finally:
        stage.abort()
    return sorted((r.path, r.removed) for r in copies)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified_ms, size) of all files under a path whose name matches: their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.unix_millis("modificationTime").alias("modified_ms"), F.col("length").alias("size"))


def remove(spark: SparkSession, chosen: DataFrame) -> tuple[int, int]:
    """Removes the files of a selection (path, size); their number and bytes. Paths come to the driver some at a time."""
    count = freed = 0
    configuration, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for row in chosen.select("path", "size").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(row.path)
        if at.getFileSystem(configuration).delete(at, False):
            count, freed = count + 1, freed + row.size
    return count, freed


def sweep(spark: SparkSession, path: str, glob: str, now_ms: int, age_ms: int = 3_600_000) -> tuple[int, int]:
    """Removes files left behind: those that match and were last changed longer ago than the age."""
    return remove(spark, files(spark, path, glob).filter(F.col("modified_ms") < now_ms - age_ms))


def beyond(found: DataFrame, most: int, budget: int) -> DataFrame:
    """Frame dumps (path, size; names begin with their time) beyond the newest ``most`` or the budget of bytes. The newest
    one always stays. Only those within the number, ``most`` at most, are ordered in one task."""
    dated = found.withColumn("_t", F.regexp_extract("path", r"(\d+)-[^/]*$", 1).cast("long"))
    newest = dated.orderBy(F.desc_nulls_last("_t"), "path").limit(most)
    order = Window.orderBy(F.desc_nulls_last("_t"), "path").rowsBetween(Window.unboundedPreceding, 0)
    kept = newest.withColumn("_sum", F.sum("size").over(order)).withColumn("_n", F.count("*").over(order)).filter((F.col("_sum") <= budget) | (F.col("_n") == 1))
    return found.join(kept.select("path"), "path", "left_anti")


def trim_dumps(spark: SparkSession, path: str, most: int, budget: int, glob: str = "*.raw") -> tuple[int, int]:
    """Removes the oldest frame dumps until their number and bytes are within bounds."""
    return remove(spark, beyond(files(spark, path, glob), most, budget))
