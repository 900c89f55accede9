"""Binary log segments and manifests as DataFrames.

A segment is a 32-byte header and fixed 27-byte little-endian records; a torn tail is ignored, tile positions are
signed, hashes are 64-bit patterns. Segments come in file-name order; a record's number counts from its segment's start.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 32
RECORD = np.dtype([("t", "<i8"), ("window_id", "<u4"), ("monitor_id", "<u2"), ("tile_x", "<i2"), ("tile_y", "<i2"), ("asset_hash", "<i8"), ("op", "u1")])
ENTRIES = "path string, record_no long, t long, window_id long, monitor_id int, tile_x short, tile_y short, asset_hash long, op int"


def read_log(spark: SparkSession, path: str, magic: bytes, glob: str = "log*.bin") -> DataFrame:
    """Entries of all segments under path. Files whose header lacks the magic raise; all-zero records are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data[: len(magic)] != magic:
                    raise ValueError(f"{name} is no log segment")
                rows = np.frombuffer(data, RECORD, (len(data) - HEADER) // RECORD.itemsize, HEADER)
                number = np.flatnonzero(rows.view(np.uint8).reshape(-1, RECORD.itemsize).any(1)) if len(rows) else np.zeros(0, np.int64)
                for at in range(0, len(number), 100_000):
                    n = number[at : at + 100_000]
                    r = rows[n]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(n)), pa.array(n), pa.array(r["t"]), pa.array(r["window_id"].astype(np.int64)), pa.array(r["monitor_id"].astype(np.int32)), pa.array(r["tile_x"]), pa.array(r["tile_y"]), pa.array(r["asset_hash"]), pa.array(r["op"].astype(np.int32))],
                        names=["path", "record_no", "t", "window_id", "monitor_id", "tile_x", "tile_y", "asset_hash", "op"],
                    )

    return files.mapInArrow(run, ENTRIES)


def between(log: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Entries of a closed range; right on unsorted input too."""
    rows = log if start is None else log.filter(F.col("t") >= start)
    return rows if end is None else rows.filter(F.col("t") <= end)


def merged(log: DataFrame) -> DataFrame:
    """All segments in time order; ties by segment name and record."""
    return log.orderBy("t", "path", "record_no")


def pointers(log: DataFrame) -> DataFrame:
    """Pointer entries: pixel position, hot spot (packed in the window id) and shape; hash 0 is hidden."""
    w = F.col("window_id")
    return log.filter("op = 4").select("t", "monitor_id", F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), w.bitwiseAND(0xFFFF).alias("hot_x"), F.shiftright(w, 16).alias("hot_y"), "asset_hash", (F.col("asset_hash") != 0).alias("visible"))
