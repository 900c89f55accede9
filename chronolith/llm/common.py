"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A session without one gets a temporary folder if it is local; on a
    cluster, where executors would not see it, that is an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, which unlike a checkpoint is compressed: for texts."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles and checkpoints that nothing refers to any more. It does so when the driver collects
    its garbage, which a driver that runs many rounds of small jobs may not do before the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id_column: str = "doc_id", folds: int = 5):
    """crc32 of the document's id as text, modulo the number of folds (null for a null id)."""
    return F.crc32(F.col(doc_id_column).cast("string").cast("binary")) % folds


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def chunks_for(size: int, chunk: int) -> int:
    """How many chunks hold texts of ``size`` bytes: each about ``chunk`` bytes, smaller ones (down to a MB) where that
    would be under 64 chunks. It depends on the data alone."""
    return max(1, -(-size // chunk), min(64, size >> 20))


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """(doc_id, text, h, chunk): whole documents dealt out evenly, all rows of a chunk in one partition.

    The chunk depends on the row alone, so that a later stage, or a task run again after a lost executor,
    finds every document in the same chunk. Null ids and null texts hash like any other value.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("chunk", F.pmod("h", F.lit(chunks)).cast("int"))
    return rows.repartition(shuffle_partitions(docs.sparkSession), "chunk")


def ordered(part: pa.Table) -> pa.Table:
    """The rows of a chunk in an order that depends on them alone."""
    return part.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])


_MODEL: dict = {}


def worker_model(key, build):
    """The model under a key, built once in a Python worker; another model's takes the place of the last one's, so
    that a worker that serves one stage after another holds one at a time."""
    if key not in _MODEL:
        _MODEL.clear()
        gc.collect()
        _MODEL[key] = build()
    return _MODEL[key]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as byte planes of their differences, which shuffle files compress well."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T).tobytes()


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)
