"""Queries over what is written to files and read back, and over streams, by name with the same results in DuckDB SQL.

Each writes the events' log (or what it names) to a new folder of the session's shared folder; folders stay until that is
cleared, as the results read them.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from chronolith.functions import codec, geo, text
from chronolith.operators import render, state, store
from chronolith.plans.catalog import AT, HOUR, QUERIES, SQL, query
from chronolith.plans.recording import Recording
from chronolith.sources import binary_log, binary_store, day_tables, log_source, maintenance, store_files
from chronolith.sources.driver_view import log, table
from chronolith.sources.shared import scratch
from chronolith.streaming import stores

__all__ = ["QUERIES", "SQL"]

MAGIC, POINT, PACK, HEAD, LIST = b"EVLOG1", b"EVSNP1", b"EVP1", b"EVAS1", b"EVMAN1"
FIELDS = ("t", "window_id", "monitor_id", "tile_x", "tile_y", "asset_hash", "op")
TIMES = [AT - 72 * HOUR, AT - 24 * HOUR, AT, AT + 30 * HOUR]
FOLD = f"""SELECT monitor_id, "at", tile_x, tile_y, asset_hash FROM (SELECT p.monitor_id, "at", tile_x, tile_y, arg_max(op, (t, event_id)) AS o, arg_max(asset_hash, (t, event_id)) AS asset_hash
  FROM p JOIN log ON log.monitor_id = p.monitor_id AND t <= "at" AND op <= 2 GROUP BY ALL) WHERE o <> 2"""


def segments(spark, sf) -> str:
    """The log as binary segments: the days' odd and even entries in two writes, so that a day has several."""
    path, rows = scratch(spark, "segments"), log(spark, sf)
    for half in (0, 1):
        log_source.write(rows.filter(F.col("event_id") % 2 == half), path, MAGIC)
    return path


def day_table(spark, sf) -> str:
    path = scratch(spark, "log")
    day_tables.append_log(log(spark, sf), path)
    return path


def numbers(rows):
    """The fields of entries under the types of the log's view."""
    return rows.select(*(F.col(c).cast("int" if c in ("tile_y", "op") else "long").alias(c) for c in FIELDS))


ALL = "SELECT t, window_id, monitor_id, tile_x, tile_y, asset_hash, op FROM log"


@query(ALL)
def written_log(spark, sf):
    return numbers(log_source.scan(spark, segments(spark, sf), MAGIC))


@query(f"{ALL} WHERE t >= {AT} AND t < {AT + 36 * HOUR}")
def log_range(spark, sf):
    rows = log_source.scan(spark, segments(spark, sf), MAGIC, in_order=True)
    return numbers(rows.filter((F.col("t") >= AT) & (F.col("t") < AT + 36 * HOUR)))


@query(f"{ALL} WHERE NOT t BETWEEN {AT} AND {AT + 30 * HOUR}")
def purged_segments(spark, sf):
    path = segments(spark, sf)
    maintenance.purge_segments(spark, path, MAGIC, AT, AT + 30 * HOUR)
    return numbers(log_source.scan(spark, path, MAGIC))


@query(f"SELECT event_id, day, t FROM log WHERE NOT t BETWEEN {AT} AND {AT + 30 * HOUR}")
def purged_log(spark, sf):
    path = day_table(spark, sf)
    maintenance.purge_log(spark, path, AT, AT + 30 * HOUR)
    return spark.read.parquet(path).select("event_id", "day", "t")


@query("SELECT event_id, day, t FROM log WHERE day >= (SELECT max(day) FROM log) - 7")
def pruned_log(spark, sf):
    path = day_table(spark, sf)
    maintenance.prune_days(spark, path, max(maintenance.Folder(spark, path).days()), 7)
    return spark.read.parquet(path).select("event_id", "day", "t")


@query(f"SELECT DISTINCT asset_hash FROM log WHERE NOT t BETWEEN {AT - 24 * HOUR} AND {AT + 400 * HOUR} AND asset_hash <> 0")
def purged_assets(spark, sf):
    tables = maintenance.Tables(day_table(spark, sf), assets=scratch(spark, "assets"))
    day_tables.append_assets(log(spark, sf).filter("asset_hash <> 0").select("asset_hash"), tables.assets)
    tables.purge(spark, AT - 24 * HOUR, AT + 400 * HOUR, now_ms=1 << 52)  # every file is old then
    return spark.read.parquet(tables.assets).select("asset_hash")


@query(f""", p AS (SELECT monitor_id, unnest({TIMES}) AS "at" FROM (SELECT DISTINCT monitor_id FROM log))
SELECT "at" AS t, monitor_id, tile_y * 16 + tile_x AS idx, asset_hash FROM ({FOLD}) log WHERE asset_hash <> 0""")
def stored_snapshots(spark, sf):
    rows, path = log(spark, sf), scratch(spark, "snapshots")
    points = rows.select("monitor_id").distinct().select("monitor_id", F.explode(F.lit(TIMES)).alias("at"))
    tiles = state.folds(rows, points).withColumn("idx", F.col("tile_y") * 16 + F.col("tile_x"))
    each = F.sort_array(F.collect_list(F.struct("idx", "asset_hash"))).alias("tiles")  # bounded by the grid
    shots = tiles.groupBy(F.col("at").alias("t"), "monitor_id").agg(each)
    grid = {"tile_size": 64, "x": 0, "y": 0, "width": 1024, "height": 4096, "columns": 16, "rows": 64}
    shots = shots.withColumns({k: F.lit(v) for k, v in grid.items()} | {"idx": F.col("tiles.idx"), "asset_hash": F.col("tiles.asset_hash")})
    store_files.write_snapshots(shots, path, POINT)
    back = binary_store.snapshot_tiles(binary_store.read_checkpoints(spark, path, POINT))
    return back.select("t", F.col("monitor_id").cast("long").alias("monitor_id"), "idx", "asset_hash")


@query(f""", p AS (SELECT monitor_id, {AT} - {100 * HOUR} + i * {20 * HOUR} AS "at" FROM range(12) r(i), (SELECT DISTINCT monitor_id FROM log))
{FOLD}""")
def states_from_snapshots(spark, sf):
    rows, path = log(spark, sf), scratch(spark, "snapshots")
    monitors = rows.select("monitor_id").distinct()
    cells = state.folds(rows, monitors.select("monitor_id", F.explode(F.lit(TIMES)).alias("at")))
    day_tables.write_snapshots(cells.withColumn("day", F.to_date(F.timestamp_micros("at"))), path)
    at = F.explode(F.sequence(F.lit(AT - 100 * HOUR), F.lit(AT + 120 * HOUR), F.lit(20 * HOUR))).alias("at")
    return day_tables.states_at(spark, day_table(spark, sf), path, monitors.select("monitor_id", at))


@query("SELECT CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS asset_hash, octet_length(encode(min(text))) AS bytes, md5(min(text)) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1")
def packed_assets(spark, sf):
    """Documents' texts as assets: two writes that overlap, read back through the index."""
    path, docs = scratch(spark, "packs"), table(spark, sf, "documents").filter("text is not null")
    key = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("asset_hash")
    assets = docs.select("doc_id", key, F.lit(1).alias("codec"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.col("text").cast("binary").alias("payload"))
    store_files.write_packs(assets.filter("doc_id % 3 > 0").drop("doc_id"), path, PACK, HEAD, 8 << 20)
    store_files.write_packs(assets.filter("doc_id % 3 < 2 or doc_id is null").drop("doc_id"), path, PACK, HEAD, 8 << 20)
    back = store_files.fetch(binary_store.read_pack_index(spark, path, PACK), path)
    return back.select("asset_hash", F.octet_length("payload").cast("long").alias("bytes"), F.md5("payload").alias("content"))


@query("SELECT DISTINCT day, asset_hash FROM log WHERE asset_hash <> 0")
def manifests(spark, sf):
    path = scratch(spark, "manifests")
    store_files.write_manifest(log(spark, sf), path, LIST)
    back = binary_store.read_manifest(spark, path, LIST)
    return back.select(F.to_date(F.regexp_extract("path", r"/(\d{4}-\d\d-\d\d)/", 1)).alias("day"), "asset_hash")


def fed(spark, rows, parts: int):
    """A stream of rows in as many micro-batches, in order of event_id."""
    path = scratch(spark, "feed")
    rows.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT asset_hash, 1 AS copies, count(*) AS refs FROM log WHERE asset_hash <> 0 GROUP BY asset_hash")
def streamed_store(spark, sf):
    """A stream stored twice over, the second time after a restart with an empty memory."""
    assets, entries = scratch(spark, "assets"), scratch(spark, "log")
    rows = log(spark, sf).drop("day").withColumn("payload", F.col("asset_hash").cast("string").cast("binary"))
    stores.store(fed(spark, rows, 4), assets, entries, scratch(spark, "offsets"), capacity=64).awaitTermination()
    kept = stores.Store(spark, assets, entries)
    kept.write(rows, 1000)
    copies = spark.read.parquet(assets).groupBy("asset_hash").agg(F.count("*").cast("int").alias("copies"))
    return copies.join(store.references(spark.read.parquet(entries).filter("batch < 1000")).select("asset_hash", "refs"), "asset_hash")


@query("SELECT day, min(t // 1000) AS start_ts, max(t // 1000) AS end_ts, count(*) AS spans FROM log GROUP BY day")
def streamed_index(spark, sf):
    """Each entry a span of no length under a title of its own, merged by a stream."""
    sessions, spans = scratch(spark, "sessions"), scratch(spark, "spans")
    ms = F.floor(F.col("t") / 1000).cast("long")
    rows = log(spark, sf).select("event_id", "day", F.lit("app").alias("app"), F.col("event_id").cast("string").alias("title"), ms.alias("start_ts"), ms.alias("end_ts"))
    stores.merge_index(fed(spark, rows, 3), sessions, spans, scratch(spark, "offsets")).awaitTermination()
    count = spark.read.parquet(spans).groupBy("day").agg(F.count("*").alias("spans"))
    return spark.read.parquet(sessions).select("day", "start_ts", "end_ts").join(count, "day")


@query("SELECT day, count(*) AS entries, min(t) AS first_t, max(t) AS last_t FROM log GROUP BY day")
def tailed_log(spark, sf):
    """Half of the segments streamed, then the rest by the same query after a restart."""
    path, out, offsets, rows = scratch(spark, "segments"), scratch(spark, "tailed"), scratch(spark, "offsets"), log(spark, sf)
    for half in (0, 1):
        log_source.write(rows.filter(F.col("event_id") % 2 == half), path, MAGIC)
        stream = log_source.tail(spark, path, MAGIC).writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets)
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("day").agg(F.count("*").alias("entries"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def flat_assets(rows):
    """Each named hash (1 to 97) as a tile of 4 x 4 opaque pixels of that blue."""

    def run(batches):
        for batch in batches:
            hashes = batch.column(0).to_pylist()
            tiles = codec.encode_many(1, [(4, 4, bytes([h, 0, 0, 255]) * 16) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array([1] * len(hashes), pa.int32()), pa.array(tiles, pa.binary())], names=["asset_hash", "codec", "payload"])

    return rows.filter("op <= 1").select("asset_hash").distinct().mapInArrow(run, "asset_hash long, codec int, payload binary")


def screens(rows):
    """A monitor of 16 columns and as many rows of cells as the log has."""
    high = (F.max("tile_y") + 1) * 4
    return rows.groupBy("monitor_id").agg(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(64).alias("width"), high.alias("height"), F.lit(4).alias("tile_size"))


@query(f"""SELECT monitor_id, count(*) AS filled, count(DISTINCT asset_hash) AS contents FROM (SELECT monitor_id, tile_x, tile_y, arg_max(op, (t, event_id)) AS o, arg_max(asset_hash, (t, event_id)) AS asset_hash
  FROM log WHERE op <= 2 AND t <= {AT} GROUP BY ALL) log WHERE o <> 2 AND asset_hash <> 0 GROUP BY monitor_id""")
def canvas_stats(spark, sf):
    return state.canvas_stats(state.fold(log(spark, sf), AT))


STEP = 5 * HOUR


@query(f""", p AS (SELECT monitor_id, {AT} + i * {STEP} AS "at" FROM range(40) r(i), (SELECT DISTINCT monitor_id FROM log))
SELECT monitor_id, "at", count(*) * 16 AS painted, CAST(sum(asset_hash) * 16 AS BIGINT) AS blue FROM ({FOLD}) log WHERE asset_hash <> 0 GROUP BY ALL""")
def film_frames(spark, sf):
    rows = log(spark, sf)
    monitors = screens(rows)
    at = F.explode(F.sequence(F.lit(AT), F.lit(AT + 39 * STEP), F.lit(STEP))).alias("at")
    points = monitors.select("monitor_id", at)
    keys = state.folds(rows, render.key_points(points, 8 * STEP))
    frames = render.filmed(rows, points, keys, render.decoded(flat_assets(rows)), monitors, 8 * STEP)

    @F.pandas_udf("painted long, blue long")
    def seen(data: pd.Series) -> pd.DataFrame:
        px = [np.frombuffer(d, np.uint8).reshape(-1, 4) for d in data]
        return pd.DataFrame({"painted": [int((p[:, 3] == 255).sum()) for p in px], "blue": [int(p[:, 0].sum()) for p in px]})

    return frames.select("monitor_id", "at", seen("bgra").alias("s")).select("monitor_id", "at", "s.*")


@query(f""", p AS (SELECT monitor_id, unnest([{AT}, {AT + 100 * HOUR}, {AT + 200 * HOUR}]) AS "at" FROM (SELECT DISTINCT monitor_id FROM log)),
q AS (SELECT monitor_id, "at" + {2 * HOUR} AS "at" FROM p), m AS (SELECT monitor_id, max(tile_y) + 1 AS high FROM log GROUP BY monitor_id),
a AS ({FOLD}), b AS (SELECT monitor_id, "at" - {2 * HOUR} AS "at", tile_x, tile_y, asset_hash FROM ({FOLD.replace("FROM p", "FROM q").replace("= p.", "= q.").replace("p.monitor", "q.monitor")}) log),
d AS (SELECT p.monitor_id, p."at", high, count(*) FILTER (a.asset_hash IS DISTINCT FROM b.asset_hash) AS cells, max(CASE WHEN a.asset_hash IS DISTINCT FROM b.asset_hash THEN abs(coalesce(a.asset_hash, 0) - coalesce(b.asset_hash, 0)) ELSE 0 END) AS worst
  FROM p JOIN m USING (monitor_id) LEFT JOIN (a FULL JOIN b USING (monitor_id, "at", tile_x, tile_y)) ON p.monitor_id = a.monitor_id AND p."at" = a."at" OR p.monitor_id = b.monitor_id AND p."at" = b."at" GROUP BY ALL)
SELECT monitor_id, "at", cells * 16 AS mismatches, CAST(worst AS INT) AS max_delta, high * 256 AS pixels, high * 16 AS tiles FROM d""")
def tile_fidelity(spark, sf):
    """Screens as they are two hours later, compared with what was recorded: every cell that changed differs."""
    rows = log(spark, sf)
    monitors, tiles = screens(rows), flat_assets(rows)
    points = monitors.select("monitor_id", F.explode(F.lit([AT, AT + 100 * HOUR, AT + 200 * HOUR])).alias("at"))
    later = points.withColumn("at", F.col("at") + 2 * HOUR)
    truth = render.rendered(state.folds(rows, later), render.decoded(tiles), monitors, ("monitor_id", "at")).withColumn("at", F.col("at") - 2 * HOUR)
    found = render.tile_diff(truth, state.folds(rows, points), tiles, monitors)
    return found.select("monitor_id", "at", "mismatches", "max_delta", "pixels", "tiles")


@query("SELECT day, count(*) AS replays, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(n) * 27 AS BIGINT) AS bytes FROM (SELECT day, segment, count(*) AS n FROM log GROUP BY ALL) GROUP BY day")
def replay_totals(spark, sf):
    return Recording(log(spark, sf)).totals()


@query("""SELECT '{"type":"replays","day":"' || day || '","replays":[' || string_agg('{"bytes":' || n * 27 || ',"distinct_windows":' || d || ',"distinct_windows_raw":' || r || ',"entries":' || n || ',"first_t":' || a || ',"last_t":' || b || ',"segment":' || segment || '}', ',' ORDER BY n) || ']}' AS message
FROM (SELECT day, segment, count(*) AS n, min(t) AS a, max(t) AS b, count(DISTINCT window_id) AS r, count(DISTINCT CASE WHEN op <= 2 THEN window_id END) AS d FROM log GROUP BY day, segment) GROUP BY day""")
def replay_rows(spark, sf):
    return Recording(log(spark, sf)).rows("replays")


@query("SELECT t, monitor_id, tile_x AS x, tile_y AS y, window_id & 65535 AS hot_x, window_id >> 16 AS hot_y, asset_hash, asset_hash <> 0 AS visible FROM log WHERE op = 4")
def pointer_rows(spark, sf):
    return binary_log.pointers(log(spark, sf))


@query("SELECT event_id, CAST(floor(tile_x * 0.75) AS BIGINT) AS x, CAST(floor(tile_y * 0.75) AS BIGINT) AS y, CAST(ceil((tile_x + 5) * 0.75) - floor(tile_x * 0.75) AS BIGINT) AS w, CAST(ceil((tile_y + 7) * 0.75) - floor(tile_y * 0.75) AS BIGINT) AS h FROM log")
def scaled_rects(spark, sf):
    x, y, w, h = geo.scaled(F.col("tile_x"), F.col("tile_y"), F.lit(5), F.lit(7), 0.75)
    return log(spark, sf).select("event_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@query("""SELECT event_id, unnest([tile_x * 8, tile_y]) AS x, unnest([tile_y * 8, tile_x]) AS y, 5 AS w, op AS h FROM log WHERE op > 0 AND (tile_x * 8 <> tile_y OR tile_y * 8 <> tile_x)""")
def moved_rects(spark, sf):
    moves = log(spark, sf).select("event_id", (F.col("tile_x") * 8).alias("x"), (F.col("tile_y") * 8).cast("long").alias("y"), F.lit(5).alias("w"), F.col("op").alias("h"), F.col("tile_y").cast("long").alias("from_x"), F.col("tile_x").alias("from_y"))
    return geo.moved(moves, "event_id")


@query("SELECT event_id, greatest(tile_x * 64, 100) AS x, greatest(tile_y * 64, 50) AS y, greatest(least(tile_x * 64 + 64, 800) - greatest(tile_x * 64, 100), 0) AS w, greatest(least(tile_y * 64 + 64, 350) - greatest(tile_y * 64, 50), 0) AS h FROM log")
def clipped_cells(spark, sf):
    x, y, w, h = geo.clipped(F.col("tile_x"), F.col("tile_y"), F.lit(100), F.lit(50), F.lit(700), F.lit(300), 64)
    return log(spark, sf).select("event_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@query("SELECT event_id, h, CAST(row_number() OVER (PARTITION BY day ORDER BY h < 0, h, event_id) AS BIGINT) AS place FROM (SELECT event_id, day, (asset_hash - 48) * 180000000000000000 AS h FROM log)")
def hash_order(spark, sf):
    rows = log(spark, sf).select("event_id", "day", ((F.col("asset_hash") - 48) * 180_000_000_000_000_000).alias("h"))
    order = state.Window.partitionBy("day").orderBy(store.unsigned(F.col("h")), "event_id")
    return rows.select("event_id", "h", F.row_number().over(order).cast("long").alias("place"))


@query("""SELECT event_id, arg, CASE WHEN k = 0 THEN 86400000000 + event_id * 1500000 WHEN k = 1 THEN (100000000000 + event_id) * 1000 WHEN k = 2 THEN 86400000000 + ((event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 60) * 1000000 END AS t
FROM (SELECT event_id, event_id % 4 AS k, CASE event_id % 4 WHEN 0 THEN '+' || printf('%.1f', event_id * 1.5) WHEN 1 THEN CAST(100000000000 + event_id AS VARCHAR) WHEN 2 THEN printf('%02d:%02d:%02d', event_id % 24, event_id % 60, event_id % 60) ELSE event_id || 's' END AS arg FROM events)""")
def time_arguments(spark, sf):
    n = F.col("event_id")
    arg = F.when(n % 4 == 0, F.concat(F.lit("+"), F.format_string("%.1f", n * 1.5))).when(n % 4 == 1, (n + 100_000_000_000).cast("string")).when(n % 4 == 2, F.format_string("%02d:%02d:%02d", n % 24, n % 60, n % 60)).otherwise(F.concat(n.cast("string"), F.lit("s")))
    rows = table(spark, sf, "events").select("event_id", arg.alias("arg"))
    return rows.withColumn("t", text.instant(F.col("arg"), F.lit(86_400_000_000)))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'no' ELSE '—' END AS flag, CASE WHEN trim(event_type) <> '' THEN trim(event_type) ELSE '—' END AS kind, printf('%.3f', event_id / 8.0) || '%' AS share FROM events")
def display_texts(spark, sf):
    flag = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    return table(spark, sf, "events").select("event_id", text.yes_no(flag).alias("flag"), text.shown(F.col("event_type")).alias("kind"), text.number(F.col("event_id") / 8, 3, "%").alias("share"))


@query("""WITH p AS (SELECT md5(text) AS asset, min(doc_id) AS n FROM documents WHERE doc_id % 3 > 0 GROUP BY 1), s AS (SELECT md5(text) AS asset, min(doc_id) AS n FROM documents WHERE doc_id % 3 < 2 GROUP BY 1)
SELECT coalesce(s.asset, p.asset) AS asset, coalesce(s.n, p.n) AS n FROM p FULL JOIN s USING (asset)""")
def stored_assets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("asset"))
    one = lambda rows: rows.groupBy("asset").agg(F.min("doc_id").alias("n"))
    return store.stored(one(docs.filter("doc_id % 3 > 0")), one(docs.filter("doc_id % 3 < 2")))


@query(f""", i AS (SELECT {AT} + k * 100000000 AS instant FROM range(3600) r(k)), g AS (SELECT * FROM (SELECT day, lag(t) OVER (PARTITION BY day ORDER BY t, event_id) AS a, t AS b, segment, lag(segment) OVER (PARTITION BY day ORDER BY t, event_id) AS was,
  max(CAST(op = 3 AS INT)) OVER (PARTITION BY day) AS beats FROM log) WHERE b - a >= 120000000 AND (was <> segment OR beats = 1 OR b - a >= 360000000))
SELECT instant, CAST(min(a) AS BIGINT) AS gap_start, CAST(arg_min(b, a) AS BIGINT) AS gap_end FROM i LEFT JOIN g ON g.day = CAST(make_timestamp(instant) AS DATE) AND instant BETWEEN a AND b GROUP BY instant""")
def film_plan(spark, sf):
    return Recording(log(spark, sf)).film(AT, AT + 100 * HOUR, fps=1, speed=100, pictures=False)
