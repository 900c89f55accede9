"""Binary log segments as a data source: split reads, live tailing, and a writer.

The layout is that of ``binary_log``: a 32-byte header, then records of 27 bytes. A partition is a range of whole
records of one segment, so a large segment is read by many tasks, each a few MB at a time. Segments lie in folders
named by day (another folder's day is null) and are ordered as if all letters were upper-case. A torn tail is ignored
until its record is whole; all-zero records are dropped, and numbers count them.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from chronolith.sources.binary_log import HEADER, RECORD
from chronolith.sources.staging import Stage, listed, opened

NAME = "activity_log"
SCHEMA = "path string, day date, segment int, record_no long, t long, window_id long, monitor_id int, tile_x short, tile_y short, asset_hash long, op int"
ARROW = pa.schema(
    [("path", pa.string()), ("day", pa.date32()), ("segment", pa.int32()), ("record_no", pa.int64()), ("t", pa.int64()), ("window_id", pa.int64()), ("monitor_id", pa.int32())]
    + [("tile_x", pa.int16()), ("tile_y", pa.int16()), ("asset_hash", pa.int64()), ("op", pa.int32())]
)
#: Bytes of a partition; records decoded at once.
SPLIT, BATCH = 64 << 20, 100_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def segment_order(path: str) -> tuple[str, str, str]:
    """Sort key of segments: the folder, then the name as if upper-case."""
    folder, name = path.rsplit("/", 1)
    return folder, name.upper(), name


def day_of(path: str) -> date | None:
    found = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", path.rsplit("/", 2)[-2])
    try:
        return found and date(*map(int, found.groups()))
    except ValueError:
        return None


class Segment:
    """A segment as listed: its path, day, number within the day, and whole records."""

    def __init__(self, path: str, number: int, size: int):
        self.path, self.day, self.number, self.records = path, day_of(path), number, max(0, size - HEADER) // RECORD.itemsize


def segments(root: str, glob: str) -> list[Segment]:
    """All segments under a path in their order; the glob is matched whatever the case."""
    files = sorted((f for f in listed(root) if fnmatchcase(f.base_name.upper(), glob.upper())), key=lambda f: segment_order(f.path))
    out: list[Segment] = []
    for f in files:
        same = out and out[-1].path.rsplit("/", 1)[0] == f.path.rsplit("/", 1)[0]
        out.append(Segment(f.path, out[-1].number + 1 if same else 0, f.size))
    return out


class Records(InputPartition):
    """A range of records of one segment."""

    def __init__(self, segment: Segment, first: int, last: int):
        self.path, self.day, self.number, self.first, self.last = segment.path, segment.day, segment.number, first, last

    def bounds(self, system) -> tuple[int, int]:
        """Times of the first and the last record."""
        with system.open_input_file(self.path) as file:
            return tuple(int.from_bytes(file.read_at(8, HEADER + n * RECORD.itemsize), "little", signed=True) for n in (self.first, self.last - 1))


def ranges(segment: Segment, first: int, last: int, split: int) -> list[Records]:
    step = max(1, split // RECORD.itemsize)
    return [Records(segment, at, min(at + step, last)) for at in range(first, last, step)]


def decoded(root: str, part: Records, magic: bytes, low: int = LOW, high: int = HIGH):
    """Batches of a partition's entries within a closed range of time."""
    system, _ = opened(root)
    with system.open_input_file(part.path) as file:
        if file.read_at(len(magic), 0) != magic:
            raise ValueError(f"{part.path} is no log segment")
        for at in range(part.first, part.last, BATCH):
            count = min(BATCH, part.last - at)
            data = file.read_at(count * RECORD.itemsize, HEADER + at * RECORD.itemsize)
            rows = np.frombuffer(data, RECORD)
            keep = np.flatnonzero(rows.view(np.uint8).reshape(-1, RECORD.itemsize).any(1) & (rows["t"] >= low) & (rows["t"] <= high))
            r = rows[keep]
            columns = [pa.repeat(pa.scalar(v, f.type), len(r)) for v, f in zip((part.path, part.day, part.number), ARROW)]
            columns += [pa.array(keep + at), *(pa.array(r[f.name].astype(f.type.to_pandas_dtype())) for f in list(ARROW)[4:])]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.magic, self.split, self.glob, self.in_order = options
        self.low, self.high, self.days = LOW, HIGH, (date.min, date.max)

    def partitions(self):
        found = [s for s in segments(self.root, self.glob) if self.days == (date.min, date.max) or s.day and self.days[0] <= s.day <= self.days[1]]
        parts = [r for s in found for r in ranges(s, 0, s.records, self.split)]
        if self.in_order and parts and (self.low, self.high) != (LOW, HIGH):
            system, _ = opened(self.root)
            with ThreadPoolExecutor(16) as pool:
                bounds = list(pool.map(lambda p: p.bounds(system), parts))
            parts = [p for p, (first, last) in zip(parts, bounds) if first <= self.high and last >= self.low]
        return parts or [InputPartition(None)]

    def read(self, partition):
        if isinstance(partition, Records):
            yield from decoded(self.root, partition, self.magic, self.low, self.high)


class PruningLogReader(LogReader):
    """Takes bounds of t and day from the query's filters; Spark still applies the filters themselves."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("t",):
                self._bound(f, 1)
            elif getattr(f, "attribute", None) == ("day",):
                self._days(f)
            yield f

    def _bound(self, f: Filter, step: int) -> None:
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + (step if isinstance(f, GreaterThan) else 0))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - (step if isinstance(f, LessThan) else 0))
        elif isinstance(f, EqualTo) and f.value is not None:
            self.low, self.high = max(self.low, f.value), min(self.high, f.value)

    def _days(self, f: Filter) -> None:
        low, high = self.days
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = max(low, f.value)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            high = min(high, f.value)
        elif isinstance(f, EqualTo) and f.value is not None:
            low, high = max(low, f.value), min(high, f.value)
        elif isinstance(f, In) and (days := [d for d in f.value if d is not None]):
            low, high = max(low, min(days)), min(high, max(days))
        self.days = low, high


class LogTail(DataSourceStreamReader):
    """Offsets are the whole records seen of each segment, by its path under the root; a segment that goes is forgotten,
    and one that got shorter gives nothing until it has grown again."""

    def __init__(self, options):
        self.root, self.magic, self.split, self.glob, _ = options

    def _seen(self) -> dict[str, Segment]:
        _, inner = opened(self.root)
        return {s.path[len(inner) + 1 :]: s for s in segments(self.root, self.glob)}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {name: s.records for name, s in self._seen().items() if s.records}

    def partitions(self, start, end):
        seen = self._seen()
        return [r for name, n in end.items() if name in seen for r in ranges(seen[name], start.get(name, 0), n, self.split)]

    def read(self, partition):
        return decoded(self.root, partition, self.magic)


class Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class LogWriter(DataSourceArrowWriter):
    """Writes each run of rows of one day to a file of its own; the commit names them as the day's next segments, in
    order of their first entry. With overwrite, the segments that the written days had before are removed."""

    def __init__(self, options, overwrite: bool):
        self.root, self.magic, _, self.glob, _ = options
        self.overwrite, self.stage = overwrite, Stage(options[0])

    def write(self, iterator):
        files, day, out = [], None, None
        try:
            for batch in iterator:
                days = batch.column("day").to_pylist()
                cuts = [0, *(i for i in range(1, len(days)) if days[i] != days[i - 1]), len(days)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if out is None or days[a] != day:
                        if out is not None:
                            out.close()
                        day = days[a]
                        path, out = self.stage.file()
                        out.write(header(self.magic, day))
                        files.append([day, batch.column("t")[a].as_py(), path])
                    rows = np.zeros(b - a, RECORD)
                    for name in RECORD.names:
                        rows[name] = batch.column(name).slice(a, b - a).to_numpy(zero_copy_only=False)
                    out.write(rows[rows.view(np.uint8).reshape(-1, RECORD.itemsize).any(1)].tobytes())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        _, inner = opened(self.root)
        there = segments(self.root, self.glob)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f[0], f[1], f[2]))
        taken = {s.path for s in there}
        moves = []
        for day, _, path in files:
            n = 0
            while (to := f"{inner}/{day}/{'log.bin' if n == 0 else f'log.{n:04d}.bin'}") in taken:
                n += 1
            taken.add(to)
            moves.append((path, to))
        days = {f[0] for f in files}
        self.stage.commit(moves, [s.path for s in there if s.day in days] if self.overwrite else [])

    def abort(self, messages):
        self.stage.abort()


def header(magic: bytes, day: date) -> bytes:
    """magic (6 bytes), version, 0, start of the day in UTC (ms), flags, sizes of header and record, 0."""
    start = (day - date(1970, 1, 1)).days * 86_400_000
    return magic.ljust(6, b"\0")[:6] + bytes([1, 0]) + np.array([start], "<u8").tobytes() + np.array([0, HEADER, RECORD.itemsize, 0], "<u4").tobytes()


class LogSource(DataSource):
    """Options: path, magic (that a header begins with), glob, splitBytes; sorted=true lets a range of time skip parts
    of a segment by the times of their first and last record, which is right only if entries are in order of time."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def _options(self):
        o = self.options
        return o["path"], o["magic"].encode("latin-1"), int(o.get("splitBytes", SPLIT)), o.get("glob", "log*.bin"), o.get("sorted", "false").lower() == "true"

    def reader(self, schema):
        return (PruningLogReader if self.options.get("pushdown") == "true" else LogReader)(self._options())

    def streamReader(self, schema):
        return LogTail(self._options())

    def writer(self, schema, overwrite):
        return LogWriter(self._options(), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def scan(spark: SparkSession, path: str, magic: bytes, in_order: bool = False, split_bytes: int = SPLIT, glob: str = "log*.bin") -> DataFrame:
    """Entries of all segments under a path, see SCHEMA. Filters on t and day reach the reader: days are skipped by their
    folders, entries before they leave Python, and with ``in_order`` parts of segments too.

    A header without the magic raises; a file too short for a header has no entries yet.
    """
    options = {"path": path, "magic": magic.decode("latin-1"), "splitBytes": split_bytes, "glob": glob, "sorted": str(in_order).lower(), "pushdown": "true"}
    return registered(spark).read.format(NAME).options(**options).load()


def tail(spark: SparkSession, path: str, magic: bytes, split_bytes: int = SPLIT, glob: str = "log*.bin") -> DataFrame:
    """A stream of the entries of all segments under a path, those there and those to come, each once, restarts included."""
    options = {"path": path, "magic": magic.decode("latin-1"), "splitBytes": split_bytes, "glob": glob}
    return registered(spark).readStream.format(NAME).options(**options).load()


def write(log: DataFrame, path: str, magic: bytes, overwrite: bool = False) -> None:
    """Adds entries (day and the fields of a record; ``event_id``, if there, breaks ties) as new segments of their days, in
    order of time; all-zero entries are dropped. With ``overwrite`` they replace the segments of their days."""
    spark, ties = registered(log.sparkSession), [c for c in ("event_id",) if c in log.columns]
    rows = log.select(F.to_date("day").alias("day"), *ties, *RECORD.names).repartitionByRange("day", "t", *ties).sortWithinPartitions("day", "t", *ties)
    rows = rows.select(F.lit("").alias("path"), "day", F.lit(0).alias("segment"), F.lit(0).cast("long").alias("record_no"), *(F.col(f.name).cast(_sql(f.type)).alias(f.name) for f in list(ARROW)[4:]))
    rows.write.format(NAME).options(path=path, magic=magic.decode("latin-1")).mode("overwrite" if overwrite else "append").save()


def _sql(kind: pa.DataType) -> str:
    return {pa.int64(): "long", pa.int32(): "int", pa.int16(): "short"}[kind]


def in_order(log: DataFrame) -> DataFrame:
    """Segments one after another, as they were written: by day, segment and record."""
    return log.orderBy("day", "segment", "record_no")


def merged(log: DataFrame) -> DataFrame:
    """All segments in order of time; ties by day, segment and record."""
    return log.orderBy("t", "day", "segment", "record_no")
