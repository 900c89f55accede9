"""Writers of the files that ``binary_store`` reads: snapshots, asset packs, manifests and frame dumps.

Each is a data source whose tasks write staged files and whose commit moves them into place (see ``staging``), so that a
task that dies, or a job that fails, leaves nothing to read. A pack's bytes are moved before its index, whose records
are what makes an asset stored. One job at a time may write under a path.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from chronolith.operators import render, store
from chronolith.sources import binary_store
from chronolith.sources.binary_store import TILE
from chronolith.sources.staging import Stage, listed, opened

#: Bytes after which a pack is closed and the next one begun; bytes of an asset's header in it.
ROLL, HEAD = 64 << 20, 24


class Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class StagedWriter(DataSourceArrowWriter):
    """Writes what ``pieces`` makes of a task's rows; ``named`` gives each staged file its place at commit."""

    def __init__(self, options):
        self.path, self.magic, self.other, self.roll = options["path"], options["magic"].encode("latin-1"), options.get("otherMagic", "").encode("latin-1"), int(options.get("rollBytes", ROLL))
        self.stage = Stage(self.path)

    def staged(self, data: bytes) -> str:
        path, out = self.stage.file()
        with out:
            out.write(data)
        return path

    def write(self, iterator):
        return Written(list(self.pieces(row for batch in iterator for row in batch.to_pylist())))

    def commit(self, messages):
        self.stage.commit(self.named(sorted(f for m in messages if m for f in m.files), opened(self.path)[1]))

    def abort(self, messages):
        self.stage.abort()


class Snapshots(StagedWriter):
    """A file for each snapshot: day/checkpoints/time.ckpt. All rows of a time must come together."""

    def pieces(self, rows):
        time, monitors = None, []

        def out():
            day = np.datetime64(time, "us").astype("datetime64[D]")
            head = self.magic[:6] + struct.pack("<BBqII", 1, 1, time, len(monitors), 0)
            return f"{day}/checkpoints/{time}.ckpt", self.staged(head + b"".join(monitors))

        for r in rows:
            if monitors and r["t"] != time:
                yield out()
                monitors = []
            time = r["t"]
            tiles = np.zeros(len(r["idx"]), TILE)
            tiles["idx"], tiles["asset_hash"] = r["idx"], r["asset_hash"]
            tiles = tiles[tiles["asset_hash"] != 0]
            monitors.append(struct.pack("<HHiiIIIII", *(r[c] for c in ("monitor_id", "tile_size", "x", "y", "width", "height", "columns", "rows")), len(tiles)) + tiles.tobytes())
        if monitors:
            yield out()

    def named(self, files, inner):
        return [(path, f"{inner}/{name}") for name, path in files]


class Packs(StagedWriter):
    """Assets one after another in packs of bounded size, with an index beside each."""

    def pieces(self, rows):
        out, index, size = None, [], 0
        try:
            for r in rows:
                if out is not None and size >= self.roll:
                    out.close()
                    yield path, self.staged(b"".join(index))
                    out, index, size = None, [], 0
                if out is None:
                    path, out = self.stage.file()
                payload, shape = r["payload"] or b"", (r["codec"], r["width"], r["height"])
                out.write(self.other[:5].ljust(5, b"\0") + struct.pack("<BHHHqI", *shape, 0, r["asset_hash"], len(payload)))
                out.write(payload)
                index.append(self.magic[:4] + struct.pack("<qqiBHHBH", r["asset_hash"], size, HEAD + len(payload), *shape, 0, 0))
                size += HEAD + len(payload)
        finally:
            if out is not None:
                out.close()
        if index:
            yield path, self.staged(b"".join(index))

    def named(self, files, inner):
        taken = [int(f.base_name[:-5]) for f in listed(self.path) if f.base_name.endswith(".pack") and f.base_name[:-5].isdigit()]
        begin = max(taken, default=-1) + 1
        return [move for n, (pack, index) in enumerate(files, begin) for move in ((pack, f"{inner}/{n:06d}.pack"), (index, f"{inner}/{n:06d}.idx"))]


class Manifests(StagedWriter):
    """Hashes of a day, eight bytes each, in parts: day/assets.idx, day/assets.0001.idx and so on."""

    def write(self, iterator):
        files, day, out = [], None, None
        try:
            for batch in iterator:
                days = batch.column("day").to_pylist()
                hashes = batch.column("asset_hash").to_numpy(zero_copy_only=False).astype("<i8")
                cuts = [0, *(i for i in range(1, len(days)) if days[i] != days[i - 1]), len(days)]
                for a, b in zip(cuts, cuts[1:]):
                    if a < b and (out is None or days[a] != day):
                        if out is not None:
                            out.close()
                        day = days[a]
                        path, out = self.stage.file()
                        out.write(self.magic[:6].ljust(6, b"\0") + b"\x01\x00")
                        files.append((str(day), path))
                    if a < b:
                        out.write(hashes[a:b].tobytes())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def named(self, files, inner):
        taken, moves = {f.path for f in listed(self.path)}, []
        for day, path in files:
            n = 0
            while (to := f"{inner}/{day}/{'assets.idx' if n == 0 else f'assets.{n:04d}.idx'}") in taken:
                n += 1
            taken.add(to)
            moves.append((path, to))
        return moves


class Frames(StagedWriter):
    """A file for each raw frame: time-monitor.raw."""

    def pieces(self, rows):
        for r in rows:
            size = r["width"] * r["height"] * 4
            if len(r["bgra"]) < size:
                raise ValueError(f"a frame of {r['width']} x {r['height']} pixels has {len(r['bgra'])} bytes")
            head = self.magic[:5].ljust(5, b"\0") + struct.pack("<BHiiIII", 1, r["monitor_id"], r["x"], r["y"], r["width"], r["height"], size)
            yield f"{r['t']}-{r['monitor_id']}.raw", self.staged(head + r["bgra"][:size])

    def named(self, files, inner):
        return [(path, f"{inner}/{name}") for name, path in files]


class Pictures(StagedWriter):
    """A file for each named content."""

    def pieces(self, rows):
        for r in rows:
            yield r["name"], self.staged(r["data"])

    def named(self, files, inner):
        return [(path, f"{inner}/{name}") for name, path in files]


class _Files(DataSource):
    writes, columns = StagedWriter, ""

    def schema(self):
        return self.columns

    def writer(self, schema, overwrite):
        return self.writes(self.options)


class SnapshotFiles(_Files):
    writes = Snapshots
    columns = "t long, monitor_id int, tile_size int, x int, y int, width long, height long, columns long, rows long, idx array<long>, asset_hash array<long>"

    @classmethod
    def name(cls):
        return "snapshot_files"


class PackFiles(_Files):
    writes, columns = Packs, "asset_hash long, codec int, width int, height int, payload binary"

    @classmethod
    def name(cls):
        return "asset_packs"


class ManifestFiles(_Files):
    writes, columns = Manifests, "day date, asset_hash long"

    @classmethod
    def name(cls):
        return "hash_manifests"


class FrameFiles(_Files):
    writes, columns = Frames, "t long, monitor_id int, x int, y int, width long, height long, bgra binary"

    @classmethod
    def name(cls):
        return "frame_dumps"


class PictureFiles(_Files):
    writes, columns = Pictures, "name string, data binary"

    @classmethod
    def name(cls):
        return "picture_files"


def _write(rows: DataFrame, source: type[_Files], path: str, magic: bytes, **options) -> None:
    rows.sparkSession.dataSource.register(source)
    options |= {"path": path, "magic": magic.decode("latin-1")}
    rows.write.format(source.name()).options(**options).mode("append").save()


def _cast(rows: DataFrame, source: type[_Files]) -> DataFrame:
    return rows.select(*(F.col(name).cast(kind).alias(name) for name, kind in (c.split() for c in source.columns.split(", "))))


def write_snapshots(snapshots: DataFrame, path: str, magic: bytes) -> None:
    """Stores snapshots, a row for each monitor with its filled tiles in two arrays; one that is written again replaces
    itself. Empty tiles (hash 0) are left out."""
    rows = _cast(snapshots, SnapshotFiles).repartition("t").sortWithinPartitions("t", "monitor_id")
    _write(rows, SnapshotFiles, path, magic)


def write_packs(new: DataFrame, path: str, magic: bytes, head: bytes, roll_bytes: int = ROLL) -> None:
    """Stores the assets (asset_hash, codec, width, height, payload) that no pack under the path has, one row a hash."""
    spark = new.sparkSession
    there = any(f.base_name.endswith(".idx") for f in listed(path))
    stored = binary_store.read_pack_index(spark, path, magic).select("asset_hash") if there else spark.createDataFrame([], "asset_hash long")
    _write(_cast(store.unseen(new, stored, "asset_hash"), PackFiles), PackFiles, path, magic, otherMagic=head.decode("latin-1"), rollBytes=roll_bytes)


def write_manifest(named: DataFrame, path: str, magic: bytes) -> None:
    """Adds a part with each hash (day, asset_hash) once a day; hash 0 names nothing. Days are spread by ranges of hashes."""
    rows = _cast(named, ManifestFiles).filter("asset_hash <> 0").distinct()
    _write(rows.repartitionByRange("day", "asset_hash").sortWithinPartitions("day", "asset_hash"), ManifestFiles, path, magic)


def write_frames(frames: DataFrame, path: str, magic: bytes) -> None:
    """Stores raw frames (t, monitor_id, x, y, width, height, bgra), a file each; one that is written again replaces itself."""
    _write(_cast(frames, FrameFiles), FrameFiles, path, magic)


def write_pictures(frames: DataFrame, path: str) -> None:
    """Stores frames (monitor_id, instant, width, height, bgra) as PNG files, instant-monitor.png; frames without pixels,
    such as instants at which nothing was recorded, have no file."""
    shown = frames.filter("bgra is not null")
    name = F.format_string("%d-%d.png", F.col("instant").cast("long"), F.col("monitor_id").cast("long")).alias("name")
    _write(shown.select(name, render.png(F.col("width"), F.col("height"), F.col("bgra")).alias("data")), PictureFiles, path, b"")


def fetch(entries: DataFrame, path: str) -> DataFrame:
    """(asset_hash, codec, width, height, payload) of entries of a pack index: only their bytes are read.

    Entries meet by pack in order of their place, so a pack is opened once and read forward; what no entry names is skipped.
    """
    kinds = pa.schema([("asset_hash", pa.int64()), ("codec", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("payload", pa.binary())])

    def run(batches):
        system, inner = opened(path)
        at, file = None, None
        for batch in batches:
            for some in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                payloads = []
                for pack, offset, length in zip(*(some.column(c).to_pylist() for c in ("pack", "offset", "length"))):
                    if pack != at:
                        at, file = pack, system.open_input_file(f"{inner}/{pack:06d}.pack")
                    payloads.append(file.read_at(length - HEAD, offset + HEAD))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kinds.names[:4]), pa.array(payloads, pa.binary())], schema=kinds)

    rows = entries.select("pack", "offset", "length", "asset_hash", F.col("codec").cast("int"), F.col("width").cast("int"), F.col("height").cast("int"))
    return rows.repartition("pack").sortWithinPartitions("pack", "offset").mapInArrow(run, PackFiles.columns)


def recover_packs(spark: SparkSession, path: str, magic: bytes) -> list[str]:
    """Removes packs of which no record can be read, with their indexes; the newest one may still be written and stays."""
    system, _ = opened(path)
    packs = {int(f.base_name[:-5]): f.path for f in listed(path) if f.base_name.endswith(".pack") and f.base_name[:-5].isdigit()}
    indexes = {f.base_name[:-4]: f.path for f in listed(path) if f.base_name.endswith(".idx")}
    live = {r.pack for r in binary_store.read_pack_index(spark, path, magic).select("pack").distinct().collect()} if indexes else set()
    gone = [n for n in sorted(packs)[:-1] if n not in live]
    for n in gone:
        for at in (packs[n], indexes.get(f"{n:06d}")):
            if at:
                system.delete_file(at)
    return [packs[n] for n in gone]


def reclaim_packs(spark: SparkSession, path: str, magic: bytes, removed: DataFrame) -> list[int]:
    """Removes the packs whose assets are all among ``removed`` (asset_hash); the newest one may still be written and stays.

    A pack's index goes first: without it nothing in the pack is stored, so a removal that is cut off harms nobody.
    """
    index = binary_store.read_pack_index(spark, path, magic).select("pack", F.col("asset_hash").alias("asset"))
    dead = sorted(r.pack for r in store.empty_packs(index, removed.select(F.col("asset_hash").alias("asset"))).collect())
    system, inner = opened(path)
    for n in dead:
        for end in ("idx", "pack"):
            system.delete_file(f"{inner}/{n:06d}.{end}")
    return dead
