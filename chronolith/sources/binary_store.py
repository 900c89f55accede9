"""Snapshots, manifests, packs, frame dumps and geometry files as DataFrames; numbers are little-endian, hashes 64-bit patterns.

Each file is parsed in the task that reads it. The magics that files begin with are parameters.
"""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import geo
from chronolith.operators.store import valid_prefix

TILE = np.dtype([("idx", "<u4"), ("asset_hash", "<i8")])
SNAPSHOT = "path string, t long, monitor_id int, tile_size int, x int, y int, width long, height long, columns long, rows long, idx array<long>, asset_hash array<long>"
FRAME = "path string, t long, monitor_id int, x int, y int, width long, height long, bgra binary"


def _files(spark: SparkSession, path: str, glob: str, *columns: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(*(columns or ("path", "content")))


def _parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    """Rows (tuples) that ``parse(path, content)`` yields of each file, handed on in small batches."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in parse(name, data):
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row))], schema=arrow)

    return files.mapInArrow(run, schema)


def read_checkpoints(spark: SparkSession, path: str, magic: bytes, version: int = 1, glob: str = "*.ckpt") -> DataFrame:
    """A row for each monitor of each snapshot, its filled tiles in two arrays (a grid bounds them).

    A header is magic (6 bytes), version, flags, time, number of monitors; a monitor 32 bytes and 12 for each tile. A
    wrong magic or version and a cut file raise. Tiles outside the grid are left out.
    """

    def parse(name, data):
        if data[:6] != magic or len(data) < 24 or data[6] != version:
            raise ValueError(f"{name} is no snapshot of version {version}")
        t, monitors = struct.unpack_from("<qI", data, 8)
        at = 24
        for _ in range(monitors):
            if at + 32 > len(data):
                raise ValueError(f"{name} is cut short")
            *head, count = struct.unpack_from("<HHiiIIIII", data, at)
            at += 32
            if at + 12 * count > len(data):
                raise ValueError(f"{name} is cut short")
            tiles = np.frombuffer(data, TILE, count, at)
            at += 12 * count
            tiles = tiles[tiles["idx"] < max(head[6] * head[7], 1)]
            yield (name, t, *head, tiles["idx"].tolist(), tiles["asset_hash"].tolist())

    return _parsed(_files(spark, path, glob), parse, SNAPSHOT)


def snapshot_tiles(snapshots: DataFrame) -> DataFrame:
    """A row for each filled tile: the base that a replay starts from, and references that keep assets."""
    tiles = F.inline(F.arrays_zip("idx", "asset_hash"))
    return snapshots.select("t", "monitor_id", "columns", "rows", tiles)


def read_manifest(spark: SparkSession, path: str, magic: bytes, glob: str = "assets*.idx") -> DataFrame:
    """(path, asset_hash): hashes of all manifests under path, 0 and a torn tail left out; a bad header gives none."""

    def parse(name, data):
        if data[:6] == magic and len(data) >= 8 and data[6] == 1:
            found = np.frombuffer(data, "<i8", (len(data) - 8) // 8, 8)
            yield name, found[found != 0].tolist()

    rows = _parsed(_files(spark, path, glob), parse, "path string, asset_hash array<long>")
    return rows.select("path", F.explode("asset_hash").alias("asset_hash"))


def read_pack_index(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """(pack, n, asset_hash, offset, length, codec, width, height) of the records that can be read.

    A pack's index ends at its first record with a wrong magic or an extent beyond the pack; a pack without an index, and
    an index without a pack, give nothing. An asset in several records is read from the last one.
    """
    record = np.dtype([("magic", "S4"), ("asset_hash", "<i8"), ("offset", "<i8"), ("length", "<i4"), ("codec", "u1"), ("width", "<u2"), ("height", "<u2"), ("rest", "V3")])

    kinds = {"asset_hash": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "codec": pa.int32(), "width": pa.int32(), "height": pa.int32()}

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                records = np.frombuffer(data, record, len(data) // record.itemsize)
                for at in range(0, len(records), 100_000):
                    r = records[at : at + 100_000]
                    columns = [pa.repeat(pa.scalar(name), len(r)), pa.array(np.arange(at, at + len(r))), pa.array(r["magic"] == magic), *(pa.array(r[c].astype(k.to_pandas_dtype())) for c, k in kinds.items())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "n", "ok", *kinds])

    number = F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("pack")
    rows = _files(spark, path, "[0-9]*.idx").mapInArrow(run, "path string, n long, ok boolean, asset_hash long, offset long, length long, codec int, width int, height int")
    packs = _files(spark, path, "[0-9]*.pack", "path", "length").select(number, F.col("length").alias("size"))
    whole = F.col("ok") & (F.col("length") >= 24) & (F.col("offset") >= 0) & (F.col("offset") + F.col("length") <= F.col("size"))
    found = valid_prefix(rows.select("*", number).drop("path").join(packs, "pack").withColumn("ok", whole))
    rest = ("pack", "n", "offset", "length", "codec", "width", "height")
    last = found.groupBy("asset_hash").agg(F.max_by(F.struct(*rest), F.struct("pack", "n")).alias("r"))
    return last.select("asset_hash", "r.*")


def read_assets(spark: SparkSession, path: str, index: DataFrame, header: int = 24) -> DataFrame:
    """(asset_hash, codec, width, height, payload) of a pack index. A pack's size bounds the entries gathered for it."""
    entries = index.groupBy("pack").agg(F.collect_list(F.struct("asset_hash", "codec", "width", "height", "offset", "length")).alias("entries"))
    number = F.regexp_extract("path", r"(\d+)\.pack$", 1).cast("long").alias("pack")
    packs = _files(spark, path, "[0-9]*.pack").select(number, "content").join(entries, "pack")
    each = packs.select("content", F.inline("entries"))
    return each.select("asset_hash", "codec", "width", "height", F.expr(f"substring(content, cast(offset as int) + {header} + 1, cast(length as int) - {header})").alias("payload"))


def read_frames(spark: SparkSession, path: str, magic: bytes, glob: str = "*.raw") -> DataFrame:
    """Raw frames; their time is in the file's name. A wrong magic, a cut file and a wrong length raise."""

    def parse(name, data):
        if data[: len(magic)] != magic or len(data) < 28:
            raise ValueError(f"{name} is no frame")
        monitor, x, y, width, height, size = struct.unpack_from("<HiiIII", data, 6)
        if size != width * height * 4 or len(data) < 28 + size:
            raise ValueError(f"{name} is cut short")
        yield name, int(name.rsplit("/", 1)[1].split("-")[0]), monitor, x, y, width, height, data[28 : 28 + size]

    return _parsed(_files(spark, path, glob), parse, FRAME)


def read_meta(spark: SparkSession, path: str, glob: str = "meta.json") -> DataFrame:
    """Monitors of all geometry files: id, place, size and the milliseconds first and last seen, in the file's order.

    Fields are found in any case; a file that isn't such JSON has no monitors.
    """
    monitor = "struct<id:int, x:int, y:int, width:int, height:int, tileSize:int, firstSeenUnixMs:bigint, lastSeenUnixMs:bigint>"
    files = spark.read.schema(f"monitors array<{monitor}>").option("multiLine", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").json(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.posexplode("monitors").alias("row", "m")).select("path", "row", "m.*")


def geometry(meta: DataFrame) -> DataFrame:
    """The dimension that a replay needs: grids in cells, and times in µs that hold for whole milliseconds."""
    ox, oy, columns, rows = geo.grid(*(F.col(c) for c in ("x", "y", "width", "height")), F.col("tileSize"))
    return meta.select(
        F.col("id").cast("long").alias("monitor_id"), columns.cast("long").alias("columns"), rows.cast("long").alias("rows"), ox.cast("long").alias("origin_x"), oy.cast("long").alias("origin_y"),
        (F.col("firstSeenUnixMs") * 1000).alias("first_t"), (F.col("lastSeenUnixMs") * 1000 + 999).alias("last_t"), F.col("row").cast("long").alias("row"),
    )
