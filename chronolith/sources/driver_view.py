"""The test tables seen as an activity log (FIXTURES.md): events become log entries, users windows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operations of a log entry.
DRAW, MOVE, CLEAR, HEARTBEAT, POINTER = range(5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, t (µs UTC), day, segment, window_id, monitor_id, tile_x, tile_y, asset_hash, op; event_id breaks ties."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    op = F.when(kind == "view", DRAW).when(kind == "purchase", MOVE).when(kind == "error", CLEAR).when(kind == "signup", HEARTBEAT).otherwise(POINTER)
    e = e.withColumns({"k": k, "op": op, "at": F.col("ts").cast("timestamp")})
    return e.select(
        "event_id", F.unix_micros("at").alias("t"), F.to_date("ts").alias("day"), (F.dayofmonth("ts") >= 16).cast("int").alias("segment"),
        F.col("user_id").alias("window_id"), (F.col("user_id") % 4).alias("monitor_id"), (F.col("k") % 16).alias("tile_x"), F.floor(F.col("k") / 16).cast("int").alias("tile_y"),
        F.when(F.col("op").isin(CLEAR, HEARTBEAT), 0).otherwise(1 + (F.col("k") * 31 + F.col("user_id")) % 97).cast("long").alias("asset_hash"), "op",
    )


LOG_SQL = """log AS (
  SELECT event_id, epoch_us(ts) AS t, CAST(ts AS DATE) AS day, CAST(day(ts) >= 16 AS INT) AS segment, user_id AS window_id, user_id % 4 AS monitor_id,
         k % 16 AS tile_x, CAST(floor(k / 16.0) AS INT) AS tile_y, CASE WHEN op IN (2, 3) THEN 0 ELSE 1 + (k * 31 + user_id) % 97 END AS asset_hash, op
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS op FROM events))"""
