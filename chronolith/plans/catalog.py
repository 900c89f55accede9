"""Queries of the log operators by name, and the same results in DuckDB SQL."""

from pyspark.sql import functions as F

from chronolith.functions import geo, text
from chronolith.operators import metrics, state, store, timeline, verify
from chronolith.plans.recording import Recording
from chronolith.sources.driver_view import LOG_SQL, log, table

AT = 1705276800000000  # 2024-01-15 00:00 UTC
HOUR = 3_600_000_000
QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {LOG_SQL}{sql}" if sql.startswith(",") else f"WITH {LOG_SQL} {sql}" if " log" in sql else sql
        return f

    return add


LAST = "SELECT monitor_id, tile_x, tile_y, arg_max(op, (t, event_id)) AS o, arg_max(asset_hash, (t, event_id)) AS asset_hash FROM log WHERE op <= 2 AND t <= {} GROUP BY ALL"


@query(f"SELECT monitor_id, tile_x, tile_y, asset_hash FROM ({LAST.format(AT)}) log WHERE o <> 2")
def seek_fold(spark, sf):
    return state.fold(log(spark, sf), AT)


@query(f"SELECT monitor_id, tile_x, tile_y, asset_hash FROM ({LAST.format(AT)}) log WHERE o <> 2")
def seek_delta(spark, sf):
    base = AT - 240 * HOUR
    rows = log(spark, sf)
    return state.fold(rows, AT, state.fold(rows, base), base)


@query("SELECT * EXCLUDE (b) FROM (SELECT event_id, t, monitor_id, tile_x, tile_y, asset_hash, lag(asset_hash) OVER (PARTITION BY monitor_id, tile_x, tile_y ORDER BY t, event_id) AS b FROM log WHERE op <= 2) WHERE b IS NULL OR b <> asset_hash")
def change_detect(spark, sf):
    return state.changes(log(spark, sf)).select("event_id", "t", "monitor_id", "tile_x", "tile_y", "asset_hash")


@query("SELECT * FROM (SELECT day, lag(t) OVER (PARTITION BY day ORDER BY t, event_id) AS start_t, t AS end_t FROM log) WHERE end_t - start_t > 2000000")
def idle_spans(spark, sf):
    return timeline.idle_spans(log(spark, sf))


@query("SELECT * FROM (SELECT day, lag(t) OVER (PARTITION BY day ORDER BY t, event_id) AS start_t, t AS end_t FROM log WHERE op <= 2) WHERE end_t - start_t > 600000000")
def idle_visual(spark, sf):
    return timeline.idle_spans(log(spark, sf), 600_000_000, (0, 1, 2))


GAPS = """, g AS (SELECT day, op, lag(t) OVER w AS start_t, t AS end_t, segment, lag(segment) OVER w AS was, max(CAST(op = 3 AS INT)) OVER (PARTITION BY day) AS beats
  FROM log {} WINDOW w AS (PARTITION BY day ORDER BY t, event_id))
SELECT day, start_t, end_t, CASE WHEN was <> segment THEN 'recording restarted' WHEN beats = 1 THEN 'recorder was not watching' ELSE 'no activity for a long stretch' END AS reason
FROM g WHERE end_t - start_t >= 120000000 AND (was <> segment OR beats = 1 OR (end_t - start_t >= 360000000{}))"""


@query(GAPS.format("", ""))
def gaps_reason(spark, sf):
    return timeline.gaps(log(spark, sf))


@query(GAPS.format("WHERE op <> 3", ""))
def gaps_fallback(spark, sf):
    return timeline.gaps(log(spark, sf).filter("op <> 3"))


@query(GAPS.format("WHERE op <> 3", " AND NOT EXISTS (SELECT 1 FROM (SELECT day AS d, min(t) + 43200000000 AS c FROM log GROUP BY day) WHERE d = day AND c > start_t AND c < end_t)"))
def gaps_checkpointed(spark, sf):
    rows = log(spark, sf)
    points = rows.groupBy("day").agg((F.min("t") + 12 * HOUR).alias("ts"))
    return timeline.gaps(rows.filter("op <> 3"), checkpoints=points)


@query(""", i AS (SELECT op, t, sum(CASE WHEN t - m <= 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY op ORDER BY t) AS island
  FROM (SELECT op, t, lag(t) OVER (PARTITION BY op ORDER BY t) AS m FROM log))
SELECT op, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM i GROUP BY op, island""")
def span_coalesce(spark, sf):
    rows = log(spark, sf).select("op", F.col("t").alias("a"), F.col("t").alias("b"))
    return timeline.coalesced(rows, "op", "a", "b", 600_000_000)


@query("SELECT day, segment, count(*) AS entries, min(t) AS first_t, max(t) AS last_t, count(DISTINCT window_id) AS distinct_windows_raw, count(DISTINCT CASE WHEN op <= 2 THEN window_id END) AS distinct_windows, count(*) * 27 AS bytes FROM log GROUP BY day, segment")
def segment_stats(spark, sf):
    return timeline.segment_stats(log(spark, sf))


@query("SELECT day, min(t) AS first_t, max(t) AS last_t, count(*) AS entries, count(DISTINCT window_id) AS windows, count(*) * 27 AS bytes, count(DISTINCT monitor_id) AS monitors, max(t) - min(t) AS span_us FROM log GROUP BY day")
def day_summary(spark, sf):
    return timeline.day_summary(log(spark, sf))


@query("SELECT window_id, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM log GROUP BY window_id")
def focus_spans(spark, sf):
    return timeline.focus_spans(log(spark, sf))


@query("SELECT day, CAST(coalesce(sum(e - s), 0) AS BIGINT) AS total_us FROM (SELECT day, window_id, min(t) AS s, max(t) AS e FROM log GROUP BY day, window_id) GROUP BY day")
def total_span(spark, sf):
    return timeline.total_span(log(spark, sf).groupBy("day", "window_id").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t")))


@query("SELECT asset_hash, min(t) AS first_t, count(*) AS refs FROM log WHERE asset_hash <> 0 GROUP BY asset_hash")
def content_refs(spark, sf):
    return store.references(log(spark, sf))


@query(f", c AS (SELECT DISTINCT monitor_id, t // {6 * HOUR} * {6 * HOUR} AS t FROM log WHERE event_id % 3 = 0) SELECT log.event_id, c.t AS ckpt FROM log ASOF LEFT JOIN c ON log.monitor_id = c.monitor_id AND log.t >= c.t")
def checkpoint_asof(spark, sf):
    rows = log(spark, sf)
    ckpt = rows.filter("event_id % 3 = 0").select("monitor_id", (F.floor(F.col("t") / (6 * HOUR)) * (6 * HOUR)).cast("long").alias("t")).distinct()
    return state.asof(rows.select("event_id", "monitor_id", "t"), ckpt.withColumn("ckpt", F.col("t")), "t", ["monitor_id"], "ckpt").select("event_id", "ckpt")


GEOMETRY = "SELECT monitor_id, tile_x // 7 AS grid, min(t) AS first_t, max(t) AS last_t, tile_x // 7 AS row FROM log WHERE event_id % 50 < 10 GROUP BY ALL"


@query(f""", g AS ({GEOMETRY}), j AS (SELECT event_id, g.grid, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(t <= last_t, FALSE) DESC,
  CASE WHEN t <= last_t THEN first_t ELSE last_t END DESC NULLS LAST, CASE WHEN t <= last_t THEN -row ELSE row END DESC NULLS LAST) AS n
  FROM log LEFT JOIN g ON log.monitor_id = g.monitor_id AND first_t <= t)
SELECT event_id, grid FROM j WHERE n = 1""")
def geometry_at(spark, sf):
    rows = log(spark, sf)
    grid = F.floor(F.col("tile_x") / 7).cast("long")
    g = rows.filter("event_id % 50 < 10").withColumn("grid", grid).groupBy("monitor_id", "grid").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t")).withColumn("row", F.col("grid"))
    return state.geometry_at(rows, g)


@query(f"SELECT monitor_id, arg_max(tile_x, (t, event_id)) AS x, arg_max(tile_y, (t, event_id)) AS y, arg_max(asset_hash, (t, event_id)) AS asset_hash FROM log WHERE op = 4 AND t <= {AT} GROUP BY monitor_id")
def pointer_state(spark, sf):
    return state.pointer(log(spark, sf), AT)


@query(f"SELECT {AT} + i * 900000000 AS instant, (SELECT max(t) FROM log WHERE t <= {AT} + i * 900000000) AS last_t FROM range(96) r(i)")
def sample_grid(spark, sf):
    return state.sampled(log(spark, sf), AT, AT + 24 * HOUR, 900_000_000)


@query(f"SELECT {AT} + i * {HOUR} AS instant, (SELECT min(t) FROM log WHERE t > {AT} + i * {HOUR}) AS next_t FROM range(200) r(i)")
def next_focus(spark, sf):
    return timeline.next_after(log(spark, sf), spark.range(200).select((F.lit(AT) + F.col("id") * HOUR).alias("instant")))


@query(f"SELECT day, count(*) AS n FROM log WHERE NOT (t BETWEEN {AT} AND {AT + 72 * HOUR}) GROUP BY day")
def purge_range(spark, sf):
    return store.purge(log(spark, sf), AT, AT + 72 * HOUR).groupBy("day").agg(F.count("*").alias("n"))


@query(f"SELECT window_id, start_t, least(end_t, {AT}) AS end_t, n FROM (SELECT window_id, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM log GROUP BY window_id) WHERE start_t < {AT}")
def trim_after(spark, sf):
    return store.trim(timeline.focus_spans(log(spark, sf)), AT)


@query(f", s AS (SELECT window_id, min(t) AS a, max(t) AS b FROM log GROUP BY window_id) SELECT window_id, a AS start_t, least(b, {AT}) AS end_t FROM s WHERE a < least(b, {AT}) UNION ALL SELECT window_id, greatest(a, {AT + HOUR}), b FROM s WHERE greatest(a, {AT + HOUR}) < b")
def span_subtract(spark, sf):
    return store.subtract(timeline.focus_spans(log(spark, sf)).drop("n"), AT, AT + HOUR)


@query("SELECT md5(text) AS asset, min(doc_id) AS first_id, count(*) AS refs FROM documents GROUP BY 1")
def content_store(spark, sf):
    return store.content(table(spark, sf, "documents"))


@query("SELECT DISTINCT md5(text) AS asset FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id)) AND md5(text) NOT IN (SELECT md5(text) FROM benchmark)")
def asset_gc(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("asset"))
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return store.garbage(docs.select("asset").distinct(), labelled, table(spark, sf, "benchmark").select(F.md5("text").alias("asset")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_docs(spark, sf):
    return store.garbage(table(spark, sf, "documents").select(F.col("doc_id").alias("asset")), table(spark, sf, "labels").select(F.col("doc_id").alias("asset"))).withColumnRenamed("asset", "doc_id")


@query("SELECT doc_id, n_chars, total FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id DESC) AS total FROM (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 120)) WHERE total <= 2000000")
def keep_budget(spark, sf):
    return store.newest(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 120, 2_000_000)


@query("SELECT l_orderkey, l_linenumber, used, CASE WHEN used > 2000 THEN 2 WHEN used > 1000 THEN 1 ELSE 0 END AS level FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS used FROM lineitem)")
def byte_budget(spark, sf):
    rows = table(spark, sf, "lineitem")
    return store.budget_level(rows, "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", 1000, slice_width=10_000).select("l_orderkey", "l_linenumber", "used", "level")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-08-02' - 30")
def retention(spark, sf):
    rows = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return store.retained(rows, "1998-08-02", 30).select("o_orderkey")


@query("SELECT vec_id, label, CAST(vec_id % 7 <> 3 AS BOOLEAN) AS ok FROM embeddings WHERE vec_id % 7 < 3 OR vec_id // 7 * 7 + 3 NOT IN (SELECT vec_id FROM embeddings)")
def valid_prefix(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 7).alias("pack"), F.col("vec_id").alias("n"), (F.col("vec_id") % 7 != 3).alias("ok"))
    return store.valid_prefix(rows).select("vec_id", "label", "ok")


def _pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return verify.frame_diff(e.join(after, "vec_id"), "vec_id", "embedding", "b", 0.05)


DIFF = """d AS (SELECT a.vec_id, unnest(range(64)) AS i, abs(CAST(unnest(a.embedding) AS DOUBLE) - CAST(unnest(b.embedding) AS DOUBLE)) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
f AS (SELECT vec_id, CAST(sum(CASE WHEN x > 0.05 THEN 1 ELSE 0 END) AS INT) AS mismatches, max(x) AS max_delta, CAST(min(CASE WHEN x > 0.05 THEN i END) AS INT) AS first_bad, CAST(max(CASE WHEN x > 0.05 THEN i END) AS INT) AS last_bad, CAST(count(*) AS INT) AS elements FROM d GROUP BY vec_id)"""


@query(f"WITH {DIFF} SELECT * FROM f")
def frame_diff(spark, sf):
    return _pairs(spark, sf)


@query(f"WITH {DIFF} SELECT count(*) AS frames, CAST(sum(CASE WHEN mismatches = 0 THEN 1 ELSE 0 END) AS BIGINT) AS exact, round(1 - sum(mismatches) / sum(elements), 9) AS pixel_ratio, round(avg(1 - mismatches / elements), 9) AS mean_ratio, min(1 - mismatches / elements) AS worst, arg_min(vec_id, (mismatches * -1, vec_id)) AS worst_at FROM f")
def fidelity(spark, sf):
    f = verify.fidelity(_pairs(spark, sf), "vec_id")
    return f.withColumns({c: F.round(c, 9) for c in ("pixel_ratio", "mean_ratio")})


@query("WITH r AS (SELECT DISTINCT md5(text) AS a FROM documents), s AS (SELECT DISTINCT md5(text) AS a FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS referenced, count(s.a) AS present, count(*) - count(s.a) AS missing, (SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT a FROM r WHERE a NOT IN (SELECT a FROM s) ORDER BY a LIMIT 5)) AS examples FROM r LEFT JOIN s USING (a)")
def integrity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("asset"))
    return verify.integrity(docs, docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"))


@query(f""", c AS (SELECT * FROM log WHERE op <= 2 AND monitor_id = 1 AND tile_x = 3 AND tile_y = 2)
SELECT count(*) AS entries, count_if(t <= {AT}) AS before, max(t) FILTER (t <= {AT}) AS t, arg_max(op, (t, event_id)) FILTER (t <= {AT}) AS op, arg_max(asset_hash, (t, event_id)) FILTER (t <= {AT}) AS asset_hash,
  arg_max(asset_hash, (t, event_id)) FILTER (t <= {AT}) > 48 AS there FROM c""")
def cell_diagnosis(spark, sf):
    rows = log(spark, sf)
    assets = rows.filter("asset_hash > 48").select("asset_hash").distinct()
    return Recording(rows, assets).diagnose(1, 3, 2, AT)


@query(f"""SELECT DISTINCT asset_hash FROM log WHERE asset_hash <> 0 AND (asset_hash IN (SELECT asset_hash FROM log WHERE t < {AT} OR t > {AT + 480 * HOUR})
  OR asset_hash IN (SELECT asset_hash FROM ({LAST.format(AT - HOUR)}) log WHERE o <> 2) OR asset_hash % 10 = 0)""")
def purge_assets(spark, sf):
    rows = log(spark, sf)
    assets = rows.filter("asset_hash <> 0").select("asset_hash").distinct().withColumn("mtime_ms", F.when(F.col("asset_hash") % 10 == 0, 9_000_000).otherwise(0))
    tiles = state.fold(rows, AT - HOUR).select("asset_hash", F.lit(AT - HOUR).alias("t"))
    return Recording(rows, assets, tiles=tiles).purge(AT, AT + 480 * HOUR, 10_000_000).assets.select("asset_hash")


SPANS = "SELECT day, CAST(monitor_id AS VARCHAR) AS app, CAST(tile_y AS VARCHAR) AS title, t // 1000 AS start_ts, t // 1000 + event_id % 90 * 60000 AS end_ts FROM log WHERE op {} 4"


@query(f""", o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY end_ts DESC, start_ts DESC, app, title) AS n FROM ({SPANS.format('=')}) log),
a AS (SELECT day, app, title, start_ts, end_ts, 0 AS k FROM o WHERE n = 1 UNION ALL SELECT *, 1 FROM ({SPANS.format('<>')}) log),
b AS (SELECT *, row_number() OVER w AS r, max(end_ts) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM a WINDOW w AS (PARTITION BY day ORDER BY k, start_ts, end_ts, app, title)),
c AS (SELECT *, e IS NULL OR end_ts > e AS latest FROM b),
d AS (SELECT *, last_value(CASE WHEN latest THEN app || '/' || title END IGNORE NULLS) OVER (PARTITION BY day ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c),
f AS (SELECT *, coalesce(held = app || '/' || title AND start_ts - e <= 60000, FALSE) AS same FROM d),
g AS (SELECT *, CASE WHEN latest OR same THEN sum(CASE WHEN latest AND NOT same THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY r ROWS UNBOUNDED PRECEDING) ELSE -r END AS i FROM f)
SELECT day, app, title, start_ts, end_ts FROM o WHERE n > 1 UNION ALL SELECT day, app, title, arg_min(start_ts, r), max(end_ts) FROM g GROUP BY day, app, title, i""")
def span_upsert(spark, sf):
    ms = F.floor(F.col("t") / 1000)
    spans = log(spark, sf).select("op", "day", F.col("monitor_id").cast("string").alias("app"), F.col("tile_y").cast("string").alias("title"), ms.alias("start_ts"), (ms + F.col("event_id") % 90 * 60000).alias("end_ts"))
    return timeline.upserted(spans.filter("op = 4").drop("op"), spans.filter("op <> 4").drop("op"), 60_000)


@query("SELECT DISTINCT monitor_id, unnest(range(CAST(floor((tile_x * 30 - 200) / 64.0) AS INT), CAST(floor((tile_x * 30 - 200 + 99) / 64.0) AS INT) + 1)) AS cx, CAST(floor((tile_y * 40 - 100) / 64.0) AS INT) AS cy FROM log WHERE op <= 2")
def dirty_cells(spark, sf):
    r = log(spark, sf).filter("op <= 2").select("monitor_id", (F.col("tile_x") * 30 - 200).alias("x"), (F.col("tile_y") * 40 - 100).alias("y"), F.lit(100).alias("w"), F.lit(1).alias("h"))
    return geo.dirty_cells(r, 64, "monitor_id")


@query("SELECT DISTINCT tile_x - 8 AS cx, tile_y AS cy, CASE WHEN tile_x - 8 BETWEEN -4 AND 3 AND tile_y BETWEEN 0 AND 3 THEN tile_y * 8 + tile_x - 4 ELSE -1 END AS idx, ((tile_x - 8) * 4294967296) + tile_y AS packed FROM log")
def cell_index(spark, sf):
    cx, cy = F.col("tile_x") - 8, F.col("tile_y")
    return log(spark, sf).select(cx.alias("cx"), cy.alias("cy"), geo.dense_index(cx, cy, -4, 0, 8, 4).alias("idx"), geo.pack(cx, cy).alias("packed")).distinct()


@query("SELECT DISTINCT asset_hash, lpad(lower(to_hex(asset_hash)), 16, '0') AS hex FROM log")
def hash_hex(spark, sf):
    return log(spark, sf).select("asset_hash", text.hash_hex(F.col("asset_hash")).alias("hex")).distinct()


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM (SELECT event_id, (t - 1704067200000000) // 1000000 AS s FROM log)")
def duration_clock(spark, sf):
    return log(spark, sf).select("event_id", text.clock(F.col("t") - 1704067200000000).alias("clock"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) ELSE printf('%.1f MB', round(n / 1048576, 1)) END AS size FROM (SELECT doc_id, n_chars AS n FROM documents)")
def bytes_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.bytes_text(F.col("n_chars")).alias("size"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(coalesce(source, ''), '^src1.*$', 'i') OR regexp_matches(coalesce(text, ''), 'toke?n = ', 'i')")
def exclusion(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter(text.excluded(F.col("source"), F.col("text"), ["SRC1*.exe"], ["/toke?n = /"])).select("doc_id")


@query("""WITH d AS (SELECT user_id, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS delta, arg_max(event_id, (ts, event_id)) - arg_min(event_id, (ts, event_id)) AS hashed FROM events GROUP BY user_id)
SELECT user_id, delta, hashed, CASE WHEN hashed = 0 THEN 100.0 ELSE 100.0 * (hashed - user_id) / hashed END AS skipped FROM d""")
def counter_delta(spark, sf):
    samples = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").alias("delta"), F.col("event_id").alias("hashed"))
    found = metrics.deltas(samples, ["user_id"], ["ts", "event_id"], ["delta", "hashed"])
    return found.withColumn("skipped", metrics.skipped_percent(F.col("hashed"), F.col("user_id")))


@query("SELECT window_id, first_t, last_t FROM (SELECT window_id, min(t) AS first_t, max(t) AS last_t FROM log GROUP BY window_id ORDER BY max(t) DESC, window_id LIMIT 64) ORDER BY first_t")
def geometry_top(spark, sf):
    return timeline.sightings(log(spark, sf), ["window_id"], 64)


@query("SELECT n, least(60000, 5000 * CAST(pow(2, least(4, n - 1)) AS BIGINT)) AS wait_ms, CASE WHEN n % 3 = 0 THEN 100.0 ELSE 100.0 * 1 / (n % 3) END AS pct FROM (SELECT DISTINCT 1 + event_id % 9 AS n FROM events)")
def backoff(spark, sf):
    n = F.col("n")
    return table(spark, sf, "events").select((1 + F.col("event_id") % 9).alias("n")).distinct().select("n", text.backoff_ms(n).alias("wait_ms"), text.percent(F.lit(1), n % 3).alias("pct"))


BAND = 5 * 24 * HOUR


@query(f""", g AS (SELECT monitor_id, t // {BAND} AS row, min(t) AS first_t, max(t) AS last_t, 8 + 4 * (t // {BAND} % 2) AS columns FROM log WHERE event_id % 50 < 10 GROUP BY ALL),
e AS (SELECT event_id, t, monitor_id, tile_x, tile_y, asset_hash, op FROM log WHERE op <> 4 AND t <= {AT} UNION ALL SELECT DISTINCT -1, {AT}, monitor_id, 0, 0, 0, 9 FROM g),
j AS (SELECT * FROM (SELECT e.*, columns, row_number() OVER (PARTITION BY e.monitor_id, event_id ORDER BY coalesce(t <= last_t, FALSE) DESC,
  CASE WHEN t <= last_t THEN first_t ELSE last_t END DESC NULLS LAST, CASE WHEN t <= last_t THEN -row ELSE row END DESC NULLS LAST) AS n
  FROM e LEFT JOIN g ON e.monitor_id = g.monitor_id AND first_t <= t) WHERE n = 1),
a AS (SELECT *, last_value(columns IGNORE NULLS) OVER (PARTITION BY monitor_id ORDER BY CASE WHEN op = 9 THEN 0 ELSE t END, event_id ROWS UNBOUNDED PRECEDING) AS c FROM j),
b AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY monitor_id ORDER BY CASE WHEN op = 9 THEN 0 ELSE t END, event_id) <> c THEN 1 ELSE 0 END AS new FROM a),
d AS (SELECT *, sum(new) OVER (PARTITION BY monitor_id ORDER BY CASE WHEN op = 9 THEN 0 ELSE t END, event_id ROWS UNBOUNDED PRECEDING) AS epoch, sum(new) OVER (PARTITION BY monitor_id) AS epochs FROM b)
SELECT monitor_id, idx, asset_hash FROM (SELECT monitor_id, CAST(tile_y * c + tile_x AS BIGINT) AS idx, arg_max(op, (t, event_id)) AS o, arg_max(asset_hash, (t, event_id)) AS asset_hash
  FROM d WHERE op <= 2 AND epoch = epochs AND tile_x < c AND tile_y < 64 GROUP BY ALL) WHERE o <> 2""")
def geometry_replay(spark, sf):
    rows = log(spark, sf)
    g = rows.filter("event_id % 50 < 10").groupBy("monitor_id", F.floor(F.col("t") / BAND).alias("row")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    g = g.withColumns({"columns": 8 + 4 * (F.col("row") % 2), "rows": F.lit(64), "origin_x": F.lit(0), "origin_y": F.lit(0)})
    return state.replay(rows, g, AT)


@query("SELECT t // 86400000000 AS step, monitor_id, tile_x, tile_y, arg_max(op, (t, event_id)) AS op, arg_max(asset_hash, (t, event_id)) AS asset_hash FROM log WHERE op <= 2 GROUP BY ALL")
def snapshot_deltas(spark, sf):
    return state.deltas(log(spark, sf), 24 * HOUR)


@query(f"SELECT max(t) FILTER (t < {AT}) AS previous_t, max(t) FILTER (t <= {AT}) AS at_t, min(t) FILTER (t > {AT}) AS next_t FROM log")
def step_event(spark, sf):
    return state.stepped(log(spark, sf), AT)


@query(f"SELECT event_id, greatest({AT}, least({AT + HOUR}, {AT} + CAST(event_id * 1000000 * CASE WHEN user_id % 3 = 0 THEN 64.0 ELSE 0.5 END AS BIGINT))) AS position FROM events")
def playhead(spark, sf):
    speed = F.when(F.col("user_id") % 3 == 0, 100.0).otherwise(0.5)
    return table(spark, sf, "events").select("event_id", state.played(F.col("event_id") * 1_000_000, speed, AT, AT, AT + HOUR).alias("position"))


@query(f"""SELECT day, instant, CAST(min(start_t) AS BIGINT) AS start_t, CAST(arg_min(end_t, start_t) AS BIGINT) AS end_t FROM (SELECT i.day, instant, start_t, end_t
  FROM (SELECT CAST(make_timestamp({AT} + i * {HOUR}) AS DATE) AS day, {AT} + i * {HOUR} AS instant FROM range(240) r(i)) i
  LEFT JOIN (SELECT * FROM (SELECT day, lag(t) OVER (PARTITION BY day ORDER BY t, event_id) AS start_t, t AS end_t FROM log) WHERE end_t - start_t >= 1200000000) g
  ON g.day = i.day AND instant BETWEEN start_t AND end_t) GROUP BY day, instant""")
def gap_at(spark, sf):
    instants = spark.range(240).select((F.lit(AT) + F.col("id") * HOUR).alias("instant")).withColumn("day", F.to_date(F.timestamp_micros("instant")))
    return timeline.gap_at(instants, timeline.gaps(log(spark, sf), 1_200_000_000))


@query("SELECT conv_id, run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY conv_id, run, role")
def focus_runs(spark, sf):
    return timeline.focus_runs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role")


@query(f"SELECT day, start_t, end_t FROM (SELECT day, lag(t) OVER (PARTITION BY day ORDER BY t, event_id) AS start_t, t AS end_t FROM log) WHERE end_t - start_t > 600000000 AND end_t > {AT} ORDER BY end_t LIMIT 1")
def skip_idle(spark, sf):
    return timeline.idle_after(timeline.idle_spans(log(spark, sf), 600_000_000), AT)


@query(f"SELECT min(start_t) AS next_t FROM (SELECT day, op, min(t) AS start_t FROM log GROUP BY day, op) WHERE op = 1 AND start_t > {AT}")
def focus_next(spark, sf):
    spans = log(spark, sf).groupBy("day", "op").agg(F.min("t").alias("start_t")).withColumn("app", F.concat(F.lit("App"), F.col("op")))
    return timeline.next_focus(spans, AT, "aPP1")


@query("SELECT day, unnest(range(t + 900000000, n, 900000000)) AS t FROM (SELECT day, t, lead(t) OVER (PARTITION BY day ORDER BY t, event_id) AS n FROM log) WHERE n - t > 900000000")
def heartbeats(spark, sf):
    return timeline.heartbeats(log(spark, sf), 900_000_000)


@query("SELECT day, min(t) // 1000 AS start_ts, max(t) // 1000 AS end_ts FROM log GROUP BY day")
def session_bounds(spark, sf):
    rows = log(spark, sf).select("day", F.floor(F.col("t") / 1000).alias("start_ts"), F.floor(F.col("t") / 1000).alias("end_ts"))
    return timeline.sessions(rows)


@query("SELECT monitor_id, tile_x, first_t, last_t FROM (SELECT monitor_id, tile_x, min(t) AS first_t, max(t) AS last_t FROM log GROUP BY ALL ORDER BY last_t DESC, monitor_id, tile_x LIMIT 32)")
def sightings(spark, sf):
    return timeline.sightings(log(spark, sf), ["monitor_id", "tile_x"], 32)


@query("SELECT pack FROM (SELECT doc_id // 3 AS pack, count(*) FILTER (md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))) AS live FROM documents GROUP BY 1) WHERE live = 0 AND pack < (SELECT max(doc_id // 3) FROM documents)")
def empty_packs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("pack"), F.md5("text").alias("asset"))
    return store.empty_packs(docs.select("pack", "asset"), docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"))


@query("SELECT count(*) AS assets, coalesce(sum(n), 0)::BIGINT AS bytes FROM (SELECT md5(text) AS a, max(octet_length(encode(text))) AS n FROM documents GROUP BY 1)")
def store_stats(spark, sf):
    docs = table(spark, sf, "documents").groupBy(F.md5("text").alias("asset")).agg(F.max(F.octet_length("text")).alias("bytes"))
    return store.store_stats(docs)


@query(f"SELECT day, count(*) AS removed FROM log WHERE t BETWEEN {AT} AND {AT + 30 * HOUR} GROUP BY day")
def purge_report(spark, sf):
    rows = log(spark, sf)
    return store.purge_report(rows, store.purge(rows, AT, AT + 30 * HOUR))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * 0.8 + x * 0.2), 6) AS average FROM events WHERE value IS NOT NULL GROUP BY user_id")
def moving_average(spark, sf):
    return metrics.moving_average(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").withColumn("average", F.round("average", 6))


@query("SELECT user_id, tiles_per_s, dedupe_percent, entries_per_s, bytes_per_hour FROM (SELECT user_id, n / s AS tiles_per_s, 100.0::DOUBLE * v / n AS dedupe_percent, n / s AS entries_per_s, n * 27 / s * 3600 AS bytes_per_hour FROM (SELECT user_id, greatest(1.0::DOUBLE, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE) AS s, count(*) AS n, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id))")
def run_summary(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    runs = table(spark, sf, "events").groupBy("user_id").agg(((F.max(us) - F.min(us)) / 1_000_000.0).alias("seconds"), F.count("*").alias("tiles_hashed"), F.count_if(F.col("event_type") == "view").alias("tiles_deduped"), F.count("*").alias("log_entries"), (F.count("*") * 27).alias("bytes_written"))
    return metrics.run_summary(runs).select("user_id", "tiles_per_s", "dedupe_percent", "entries_per_s", "bytes_per_hour")


SOAK = """r AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, value AS v, event_id % 977 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
q AS (SELECT *, CASE WHEN n >= 4 THEN 1 ELSE 0 END AS b FROM r), p AS (SELECT *, greatest(b + 1, n // 2) AS m FROM q WHERE n > 1),
f AS (SELECT user_id, count(*) AS samples, avg(v) FILTER (i >= 1) AS cpu, min(h) FILTER (i >= b AND i < m) AS early_floor, min(h) FILTER (i >= m) AS late_floor, max(h) FILTER (i >= m) AS late_peak,
  max(v) FILTER (i = b) AS m0, max(v) FILTER (i = n - 1) AS m2, max(s) FILTER (i = b) AS s0, max(s) FILTER (i = m) AS s1, max(s) AS s2 FROM p GROUP BY user_id)"""


@query(f"WITH {SOAK} SELECT user_id, samples, round(cpu, 6) AS cpu_average, early_floor, late_floor, late_peak, round(greatest(0, m2 - m0) / greatest(0.01, (s2 - s0) / 3600.0), 6) AS memory_per_hour, round(greatest(0, late_floor - early_floor)::DOUBLE / greatest(0.01, (s2 - s1) / 3600.0), 6) AS handles_per_hour, CASE WHEN samples < 20 THEN 'INVALID' WHEN cpu < 60 AND late_floor <= early_floor THEN 'PASS' ELSE 'FAIL' END AS verdict FROM f")
def soak_verdict(spark, sf):
    e = table(spark, sf, "events")
    samples = e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("seconds"), F.col("value").alias("cpu"), F.col("value").alias("memory"), (F.col("event_id") % 977).alias("handles"))
    g = metrics.growth(samples, ["user_id"])
    judged = metrics.verdict(F.col("samples") >= 20, F.col("cpu_average") < 60, F.col("late_floor") <= F.col("early_floor"))
    return g.withColumn("verdict", judged).withColumns({c: F.round(c, 6) for c in ("cpu_average", "memory_per_hour", "handles_per_hour")})


@query("SELECT event_id, CASE WHEN d > 100 THEN 100.0::DOUBLE * u / (d * 4) ELSE 0.0::DOUBLE END AS cpu_percent FROM (SELECT event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS d, event_id % 1000 - lag(event_id % 1000) OVER w AS u FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id % 1000))")
def cpu_percent(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t_ms"), (F.col("event_id") % 1000).alias("cpu_ms"))
    return metrics.cpu_percent(e, ["user_id"], 4).select("event_id", "cpu_percent")


@query("""SELECT frame, CASE WHEN out OR regions = 0 THEN 'full' WHEN regions <= 8 AND covered <= 200000 THEN 'parts' WHEN (r - l) * (b - t) <= 200000 THEN 'box' ELSE 'full' END AS plan, regions, covered::BIGINT AS covered, l AS left, t AS top, r AS right, b AS bottom
FROM (SELECT frame, bool_or(NOT ok) AS out, count(*) FILTER (ok) AS regions, coalesce(sum((r - l) * (b - t)) FILTER (ok), 0) AS covered, CAST(min(l) FILTER (ok) AS INT) AS l, CAST(min(t) FILTER (ok) AS INT) AS t, CAST(max(r) FILTER (ok) AS INT) AS r, CAST(max(b) FILTER (ok) AS INT) AS b
  FROM (SELECT frame, x + 90 <= 800 AND y + 30 <= 500 AS ok, greatest(0, x // 64 * 64) AS l, greatest(0, y // 64 * 64) AS t, least(800, ((x + 89) // 64 + 1) * 64) AS r, least(500, ((y + 29) // 64 + 1) * 64) AS b
    FROM (SELECT event_id // 4 AS frame, tile_x * 48 AS x, tile_y * 70 AS y FROM log WHERE op <= 2)) GROUP BY frame)""")
def readback_plan(spark, sf):
    rects = log(spark, sf).filter("op <= 2").select(F.floor(F.col("event_id") / 4).alias("frame"), (F.col("tile_x") * 48).alias("x"), (F.col("tile_y") * 70).alias("y"), F.lit(90).alias("w"), F.lit(30).alias("h"))
    return geo.readback(rects, "frame", 800, 500, 0, 0, 64)


@query("SELECT monitor_id, min(tile_x) * 64 AS x, min(tile_y) * 64 AS y, (max(tile_x) - min(tile_x)) * 64 + 64 AS w, (max(tile_y) - min(tile_y)) * 64 + 64 AS h FROM log GROUP BY monitor_id")
def desktop_box(spark, sf):
    rects = log(spark, sf).select("monitor_id", (F.col("tile_x") * 64).alias("x"), (F.col("tile_y") * 64).alias("y"), F.lit(64).alias("w"), F.lit(64).alias("h"))
    return geo.bounding_box(rects, "monitor_id")


@query("SELECT event_id, greatest(5.0::DOUBLE, least(2000.0::DOUBLE, 1000.0 * n / (0.01 * 8 * 1000) * (1 + 0.5 * (n % 5)))) AS pace, least(200, 15 * CAST(pow(2, least(n, 6)) AS BIGINT)) AS wait FROM (SELECT event_id, user_id % 60 AS n FROM events)")
def pacing(spark, sf):
    n = F.col("user_id") % 60
    return table(spark, sf, "events").select("event_id", metrics.pace_ms(n, 8, n % 5, 5.0, 2000.0).alias("pace"), metrics.timeout_ms(n, 200).alias("wait"))


@query(f""", p AS (SELECT monitor_id, {AT} + i * {6 * HOUR} AS "at" FROM range(4) r(i), (SELECT DISTINCT monitor_id FROM log))
SELECT monitor_id, "at", tile_x, tile_y, asset_hash FROM (SELECT p.monitor_id, "at", tile_x, tile_y, arg_max(op, (t, event_id)) AS o, arg_max(asset_hash, (t, event_id)) AS asset_hash
  FROM p JOIN log ON log.monitor_id = p.monitor_id AND t <= "at" AND op <= 2 GROUP BY ALL) WHERE o <> 2""")
def states_at(spark, sf):
    rows = log(spark, sf)
    at = F.explode(F.sequence(F.lit(AT), F.lit(AT + 18 * HOUR), F.lit(6 * HOUR))).alias("at")
    return state.folds(rows, rows.select("monitor_id").distinct().select("monitor_id", at))


@query("SELECT event_id, CASE WHEN ms < 1000 THEN printf('%dms', CAST(ms AS BIGINT)) WHEN s < 10 THEN printf('%.1fs', round(s, 1)) WHEN s < 60 THEN printf('%.0fs', round(s)) WHEN s >= 3600 THEN printf('%dh %02dm', n // 3600, n % 3600 // 60) ELSE printf('%dm %02ds', n // 60, n % 60) END AS took, CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%d:%02d', n // 60, n % 60) END AS clock FROM (SELECT event_id, us / 1000.0::DOUBLE AS ms, us / 1000000.0::DOUBLE AS s, us // 1000000 AS n FROM (SELECT event_id, event_id * event_id * 1000 AS us FROM events))")
def duration_text(spark, sf):
    us = F.col("event_id") * F.col("event_id") * 1000
    return table(spark, sf, "events").select("event_id", text.duration(us).alias("took"), text.duration_clock(us).alias("clock"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'excluded' WHEN event_id % 13 = 0 THEN 'protected' WHEN event_type = 'click' THEN 'unchanged' ELSE 'recorded' END AS disposition FROM events")
def frame_gate(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", text.disposition(i % 11 == 0, i % 13 == 0, F.when(F.col("event_type") == "click", 0).otherwise(2)).alias("disposition"))


@query(f""", s AS (SELECT day, min(t // 1000 - 60000) AS a, max(t // 1000) AS b FROM log WHERE op = 3 GROUP BY day), w AS (SELECT day, sum(k) AS span_ms FROM (SELECT day, event_id % 90 * 1000 AS k FROM log WHERE op = 4) GROUP BY day),
c AS (SELECT day, count(*) AS snapshots FROM (SELECT DISTINCT day, t // {HOUR} FROM log WHERE op = 2) GROUP BY day)
SELECT day, least(any_value(a), min(t // 1000)) AS start_ts, greatest(any_value(b), max(t // 1000)) AS end_ts, count(*) AS entries, CAST(coalesce(any_value(span_ms), 0) AS BIGINT) AS span_ms, coalesce(any_value(snapshots), 0) AS snapshots
FROM log LEFT JOIN s USING (day) LEFT JOIN w USING (day) LEFT JOIN c USING (day) GROUP BY day""")
def day_list(spark, sf):
    rows, ms = log(spark, sf), F.floor(F.col("t") / 1000)
    sighted = rows.filter("op = 3").select("day", (ms - 60000).alias("start_ts"), ms.alias("end_ts"))
    spans = rows.filter("op = 4").select("day", ms.alias("start_ts"), (ms + F.col("event_id") % 90 * 1000).alias("end_ts"))
    snapshots = rows.filter("op = 2").select("day", F.floor(F.col("t") / HOUR)).distinct()
    return timeline.day_list(rows, sighted, spans, snapshots)


@query(f""", tiles AS (SELECT DISTINCT 100 + asset_hash % 7 AS h FROM log WHERE op = 2 OR t <= {AT} AND op = 1), r AS (SELECT asset_hash AS h FROM log WHERE op <= 1 UNION SELECT h FROM tiles),
a AS (SELECT DISTINCT asset_hash AS h FROM log WHERE op = 0 AND asset_hash % 5 <> 0), j AS (SELECT r.h, a.h AS there, a.h % 11 = 0 AS bad FROM r LEFT JOIN a USING (h) WHERE r.h <> 0)
SELECT (SELECT count(*) FROM log) AS entries, count(*) AS referenced, count_if(there IS NOT NULL AND NOT bad) AS present, count_if(there IS NULL) AS missing, count_if(bad) AS corrupt,
  (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT h FROM j WHERE there IS NULL OR bad ORDER BY h LIMIT 5)) AS examples FROM j""")
def integrity_report(spark, sf):
    rows = log(spark, sf)
    tiles = rows.filter(f"op = 2 or t <= {AT} and op = 1").select((100 + F.col("asset_hash") % 7).alias("asset_hash"))
    assets = rows.filter("op = 0 and asset_hash % 5 <> 0").select("asset_hash", (F.col("asset_hash") % 11 != 0).alias("ok")).distinct()
    return verify.report(rows, tiles, assets)


@query("""SELECT DISTINCT asset_hash, substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.tile' AS asset, CASE WHEN n = 0 THEN 'log.bin' ELSE 'log.' || lpad(CAST(n AS VARCHAR), 4, '0') || '.bin' END AS segment,
  n * 180000000 || '.ckpt' AS snapshot, n * 180000000 AS snapshot_t
FROM (SELECT asset_hash, lpad(lower(to_hex(asset_hash)), 16, '0') AS h, asset_hash % 12 AS n FROM log) log""")
def stored_names(spark, sf):
    n = F.col("asset_hash") % 12
    name = text.snapshot_name(n * 180_000_000)
    rows = log(spark, sf).select("asset_hash").distinct()
    return rows.select("asset_hash", text.asset_path(F.col("asset_hash")).alias("asset"), text.segment_name(n).alias("segment"), name.alias("snapshot"), text.snapshot_time(name).alias("snapshot_t"))


@query(f""", g AS (SELECT monitor_id, CAST(floor(tile_x / 7.0) AS BIGINT) AS grid, min(t) AS first_t, max(t) AS last_t FROM log WHERE event_id % 50 < 10 AND t > {AT - 24 * HOUR} GROUP BY ALL)
SELECT monitor_id, first_t, grid, last_t, grid AS row FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY last_t >= {AT} DESC, CASE WHEN last_t >= {AT} THEN first_t ELSE last_t END DESC, CASE WHEN last_t >= {AT} THEN grid ELSE -grid END) AS n FROM g WHERE first_t <= {AT}) log WHERE n = 1""")
def monitors_at(spark, sf):
    rows = log(spark, sf).filter(f"event_id % 50 < 10 and t > {AT - 24 * HOUR}").withColumn("grid", F.floor(F.col("tile_x") / 7).cast("long"))
    g = rows.groupBy("monitor_id", "grid").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t")).withColumn("row", F.col("grid"))
    return state.monitors_at(g, AT).select("monitor_id", "first_t", "grid", "last_t", "row")


@query("SELECT day, CAST(monitor_id AS VARCHAR) AS app, CASE WHEN tile_y % 2 = 0 THEN '' ELSE CAST(tile_y AS VARCHAR) END AS title, min(t // 1000) AS first_ts FROM log WHERE op = 4 GROUP BY ALL")
def window_list(spark, sf):
    title = F.when(F.col("tile_y") % 2 != 0, F.col("tile_y").cast("string"))
    return timeline.windows(log(spark, sf).filter("op = 4").select("day", F.col("monitor_id").cast("string").alias("app"), title.alias("title"), F.floor(F.col("t") / 1000).alias("start_ts")))
