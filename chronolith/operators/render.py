"""Frames from cells: decoding, rendering and comparison of pixels. Python, one frame (bounded by its monitor) at a time."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions import codec
from chronolith.operators import state

DIFF = "mismatches long, max_delta int, left int, top int, right int, bottom int, pixels long"


def decoded(assets: DataFrame, verify: bool = False) -> DataFrame:
    """(asset_hash, tile_w, tile_h, bgra) of assets (asset_hash, codec, payload): decode once, before any join with cells.

    An asset that can't be decoded, or with ``verify`` doesn't hash to its key, is left out: a hole, never an error. Tiles
    of a batch are decoded side by side.
    """

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), codec.LANES):
                some = pdf.iloc[at : at + codec.LANES]
                found = codec.decode_many(some.codec.tolist(), [bytes(p or b"") for p in some.payload])
                out = [(h, *tile) for h, tile in zip(some.asset_hash.tolist(), found) if tile and (not verify or codec.tile_hash_of(*tile) == h)]
                yield pd.DataFrame(out, columns=["asset_hash", "tile_w", "tile_h", "bgra"])

    return assets.select("asset_hash", "codec", "payload").mapInPandas(run, "asset_hash long, tile_w int, tile_h int, bgra binary")


def rendered(cells: DataFrame, tiles: DataFrame, monitors: DataFrame, by: tuple[str, ...] = ("monitor_id",)) -> DataFrame:
    """(by, width, height, bgra): each monitor's frame from its cells (by, tile_x, tile_y, asset_hash).

    ``monitors``: monitor_id, x, y, width, height, tile_size. Cells without content or asset stay transparent black; a
    monitor without cells is an empty frame. ``by`` may hold an instant besides monitor_id.
    """
    monitors = monitors.select("monitor_id", "x", "y", "width", "height", "tile_size")
    keys = cells.select(*by).distinct() if len(by) > 1 else monitors.select("monitor_id")
    filled = cells.filter("asset_hash <> 0").select(*by, "tile_x", "tile_y", "asset_hash").join(tiles, "asset_hash").drop("asset_hash")
    rows = keys.join(monitors, "monitor_id").join(filled, list(by), "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.iloc[0]
        canvas = np.zeros((int(m.height), int(m.width), 4), np.uint8)
        for r in pdf[pdf.bgra.notna()].itertuples():
            left, top = int(r.tile_x) * int(m.tile_size), int(r.tile_y) * int(m.tile_size)
            x, y = max(left, int(m.x)) - int(m.x), max(top, int(m.y)) - int(m.y)
            size = (min(left + m.tile_size, m.x + m.width) - m.x - x, min(top + m.tile_size, m.y + m.height) - m.y - y)
            w, h = min(int(size[0]), int(r.tile_w)), min(int(size[1]), int(r.tile_h))
            if w > 0 and h > 0:
                canvas[y : y + h, x : x + w] = np.frombuffer(r.bgra, np.uint8).reshape(int(r.tile_h), int(r.tile_w), 4)[:h, :w]
        return pd.DataFrame([[*(m[c] for c in by), int(m.width), int(m.height), canvas.tobytes()]], columns=[*by, "width", "height", "bgra"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", width int, height int, bgra binary")


FILM = "monitor_id long, at long, width int, height int, bgra binary"


def _place(canvas: np.ndarray, monitor, tile_x: int, tile_y: int, tile) -> None:
    """Clears a cell of a canvas and draws its tile (width, height, pixels) there, if it has one."""
    left, top = tile_x * monitor["tile_size"] - monitor["x"], tile_y * monitor["tile_size"] - monitor["y"]
    x, y = max(left, 0), max(top, 0)
    right, bottom = min(left + monitor["tile_size"], monitor["width"]), min(top + monitor["tile_size"], monitor["height"])
    if right > x and bottom > y:
        canvas[y:bottom, x:right] = 0
        if tile is not None:
            w, h = min(right - x, tile[0]), min(bottom - y, tile[1])
            canvas[y : y + h, x : x + w] = np.frombuffer(tile[2], np.uint8).reshape(tile[1], tile[0], 4)[:h, :w]


def filmed(log: DataFrame, points: DataFrame, keys: DataFrame, tiles: DataFrame, monitors: DataFrame, slice_us: int) -> DataFrame:
    """(monitor_id, at, width, height, bgra): frames at many points (monitor_id, at), equal to ``rendered`` over the
    points' states, of which only the changed cells travel.

    Points are cut into slices of time. A slice starts from a key frame, the state at its first point, which ``keys``
    gives (monitor_id, at, tile_x, tile_y, asset_hash; ``state.folds`` or ``day_tables.states_at`` of ``key_points``);
    from there its canvas is carried from frame to frame, and cells that changed are drawn anew. A group holds one
    slice's tiles, each content once, and hands on one frame at a time. A frame without any cell is left out.
    """
    cut = F.floor(F.col("at") / slice_us).alias("slice")
    numbered = points.select("monitor_id", "at", cut).distinct()
    first = key_points(points, slice_us)
    changed = state.arrivals(log, numbered.join(first.withColumnRenamed("at", "base"), ["monitor_id", "slice"]).select("monitor_id", "at", "base"))
    begun = keys.select("monitor_id", "at", "tile_x", "tile_y", "asset_hash", cut)
    moves = begun.unionByName(changed.select("monitor_id", "at", "tile_x", "tile_y", "asset_hash", cut))
    # what each frame does to its canvas, and the slice's contents, once each
    frames = numbered.join(moves.groupBy("monitor_id", "slice", "at").agg(F.collect_list(F.struct("tile_x", "tile_y", "asset_hash")).alias("moves")), ["monitor_id", "slice", "at"], "left")
    m = monitors.select(F.col("monitor_id").alias("_m"), F.struct(*(F.col(c).cast("long").alias(c) for c in ("x", "y", "width", "height", "tile_size"))).alias("monitor"))
    frames = frames.join(m, F.col("monitor_id") == F.col("_m")).drop("_m")
    contents = moves.filter("asset_hash <> 0").select("monitor_id", "slice", "asset_hash").distinct().join(tiles, "asset_hash")
    both = frames.unionByName(contents.select("monitor_id", "slice", "asset_hash", "tile_w", "tile_h", "bgra"), allowMissingColumns=True)
    return both.groupBy("monitor_id", "slice").applyInArrow(_drawn, FILM)


def _drawn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of a slice one after another; only its contents, its moves and one canvas are held."""
    stock, frames, canvas, filled = {}, [], None, set()
    for batch in batches:
        for r in batch.to_pylist():
            if r["at"] is None:
                stock[r["asset_hash"]] = (r["tile_w"], r["tile_h"], r["bgra"])
            else:
                frames.append((r["at"], r["moves"] or (), r["monitor"]))
    kinds = {"monitor_id": pa.int64(), "at": pa.int64(), "width": pa.int32(), "height": pa.int32(), "bgra": pa.binary()}
    for at, moved, monitor in sorted(frames, key=lambda f: f[0]):
        if canvas is None:
            canvas = np.zeros((monitor["height"], monitor["width"], 4), np.uint8)
        for c in moved:
            place, h = (c["tile_x"], c["tile_y"]), c["asset_hash"]
            (filled.discard if h is None else filled.add)(place)
            _place(canvas, monitor, *place, stock.get(h))
        if filled:
            row = (key[0].as_py(), at, monitor["width"], monitor["height"], canvas.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds.values())], names=list(kinds))


def key_points(points: DataFrame, slice_us: int) -> DataFrame:
    """(monitor_id, slice, at): each slice's first point, whose state is its key frame."""
    return points.groupBy("monitor_id", F.floor(F.col("at") / slice_us).alias("slice")).agg(F.min("at").alias("at"))


PARTIAL = "mismatches long, max_delta int, left int, top int, right int, bottom int"


def _compared(a: np.ndarray, b: np.ndarray, left: int, top: int, tolerance: int) -> tuple:
    """PARTIAL of two blocks of pixels (BGRA) whose corner lies at (left, top)."""
    delta = np.abs(a[:, :, :3].astype(np.int16) - b[:, :, :3]).max(axis=2, initial=0)
    ys, xs = np.nonzero(delta > tolerance)
    box = (left + int(xs.min()), top + int(ys.min()), left + int(xs.max()) + 1, top + int(ys.max()) + 1) if len(ys) else (None,) * 4
    return (len(ys), int(delta.max(initial=0)), *box)


def tile_diff(truth: DataFrame, cells: DataFrame, assets: DataFrame, monitors: DataFrame, by: tuple[str, ...] = ("monitor_id", "at"), tolerance: int = 0) -> DataFrame:
    """(by, mismatches, max_delta, left, top, right, bottom, pixels, tiles, decoded): frames taken from the screen against
    the cells recorded for them, as ``pixel_diff`` gives for the rendered frames, without rendering any.

    ``truth``: by, width, height, bgra; ``cells``: by, tile_x, tile_y, asset_hash; ``assets``: asset_hash, codec, payload.
    A truth frame is cut into its monitor's tiles, whose hashes are compared with the recorded ones first: equal ones are
    equal, where the codec loses nothing. Only the others go on, each to its asset, which is decoded once whatever the
    number of frames; ``decoded`` counts a frame's tiles that needed one. A cell's recorded content that is missing or
    can't be decoded counts as transparent black, a frame of another size or without cells as different everywhere.
    """
    known = assets.select("asset_hash", F.col("codec").isin(1, 3).alias("exact")).dropDuplicates(["asset_hash"])
    listed = cells.select(*by, "tile_x", "tile_y", "asset_hash").join(known, "asset_hash", "left")
    listed = listed.groupBy(*by).agg(F.collect_list(F.struct("tile_x", "tile_y", "asset_hash", "exact")).alias("cells"))
    m = monitors.select(F.col("monitor_id").alias("_m"), F.struct(*(F.col(c).cast("long").alias(c) for c in ("x", "y", "width", "height", "tile_size"))).alias("monitor"))
    frames = truth.select(*by, "width", "height", "bgra").join(m, F.col("monitor_id") == F.col("_m")).drop("_m").join(listed, list(by), "left")
    kinds = dict(truth.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    names = [*by, "mismatches", "max_delta", "left", "top", "right", "bottom", "pixels", "tiles", "wanted", "tile_w", "tile_h", "truth"]

    def cut(batches):
        for pdf in batches:
            for f in pdf.to_dict("records"):
                yield pd.DataFrame(_tiles_of(f, by, tolerance), columns=names, dtype=object).astype({c: "Int64" for c in names[len(by) : -1]})

    parts = frames.mapInPandas(cut, f"{keys}, {PARTIAL}, pixels long, tiles long, wanted long, tile_w int, tile_h int, truth binary")
    settled, open_ones = parts.filter("wanted is null"), parts.filter("wanted is not null")
    stock = decoded(assets.join(open_ones.select(F.col("wanted").alias("asset_hash")).distinct(), "asset_hash", "left_semi").dropDuplicates(["asset_hash"]))
    stock = stock.select(F.col("asset_hash").alias("wanted"), F.col("tile_w").alias("w"), F.col("tile_h").alias("h"), "bgra")
    met = open_ones.join(stock, "wanted", "left")

    @F.pandas_udf(PARTIAL)
    def compare(truth: pd.Series, tile_w: pd.Series, tile_h: pd.Series, left: pd.Series, top: pd.Series, w: pd.Series, h: pd.Series, bgra: pd.Series) -> pd.DataFrame:
        out = []
        for t, tw, th, x, y, own_w, own_h, px in zip(truth, tile_w, tile_h, left, top, w, h, bgra):
            a, b = np.frombuffer(t, np.uint8).reshape(int(th), int(tw), 4), np.zeros((int(th), int(tw), 4), np.uint8)
            if px is not None:
                own = np.frombuffer(px, np.uint8).reshape(int(own_h), int(own_w), 4)[: int(th), : int(tw)]
                b[: own.shape[0], : own.shape[1]] = own
            out.append(_compared(a, b, int(x), int(y), tolerance))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PARTIAL.split(", ")]).astype({c: "Int32" for c in ("left", "top", "right", "bottom")})

    compared = met.select(*by, compare("truth", "tile_w", "tile_h", "left", "top", "w", "h", "bgra").alias("d"), "pixels", "tiles", F.lit(1).alias("decoded")).select(*by, "d.*", "pixels", "tiles", "decoded")
    both = settled.select(*by, "mismatches", "max_delta", "left", "top", "right", "bottom", "pixels", "tiles", F.lit(0).alias("decoded")).unionByName(compared)
    sums = [F.sum(c).cast("long").alias(c) for c in ("mismatches", "pixels", "tiles", "decoded")]
    found = both.groupBy(*by).agg(F.max("max_delta").alias("max_delta"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), *sums)
    return found.select(*by, "mismatches", "max_delta", "left", "top", "right", "bottom", "pixels", "tiles", "decoded")


def _tiles_of(f: dict, by: tuple[str, ...], tolerance: int) -> list[tuple]:
    """A row of what is settled in a frame, and one for each tile that must be compared with its asset."""
    key, m, w, h = tuple(f[c] for c in by), f["monitor"], int(f["width"]), int(f["height"])
    n = len(f["bgra"]) // 4
    cells = {(c["tile_x"], c["tile_y"]): c for c in (f["cells"] if f["cells"] is not None else ())}
    if not cells or (m["width"], m["height"]) != (w, h) or n != w * h:
        return [(*key, n, 255, 0, 0, w, n // max(w, 1), n, 0, *(None,) * 4)]
    canvas, size = np.frombuffer(f["bgra"], np.uint8).reshape(h, w, 4), m["tile_size"]
    bad, most, boxes, pixels, count, rows = 0, 0, [], 0, 0, []
    for ty in range(m["y"] // size, (m["y"] + h - 1) // size + 1):
        for tx in range(m["x"] // size, (m["x"] + w - 1) // size + 1):
            left, top = max(tx * size - m["x"], 0), max(ty * size - m["y"], 0)
            right, bottom = min((tx + 1) * size - m["x"], w), min((ty + 1) * size - m["y"], h)
            block = np.ascontiguousarray(canvas[top:bottom, left:right])
            data, cell = block.tobytes(), cells.get((tx, ty))
            stored = cell is not None and cell["asset_hash"] not in (None, 0) and cell["exact"] is not None
            if stored and not (cell["exact"] and codec.tile_hash_of(right - left, bottom - top, data) == cell["asset_hash"]):
                rows.append((*key, 0, 0, left, top, None, None, (right - left) * (bottom - top), 1, cell["asset_hash"], right - left, bottom - top, data))
                continue
            pixels, count = pixels + (right - left) * (bottom - top), count + 1
            if not stored:
                one = _compared(block, np.zeros_like(block), left, top, tolerance)
                bad, most = bad + one[0], max(most, one[1])
                boxes += [one[2:]] if one[0] else []
    box = (*map(min, list(zip(*boxes))[:2]), *map(max, list(zip(*boxes))[2:])) if boxes else (None,) * 4
    return [(*key, bad, most, *box, pixels, count, *(None,) * 4), *rows]


def pixel_diff(frames: DataFrame, by: tuple[str, ...], a: str, b: str, tolerance: int = 0) -> DataFrame:
    """(by, mismatches, max_delta, left, top, right, bottom, pixels): BGRA frames of one size compared by colour.

    A pixel differs if a colour is more than tolerance apart; the box (ends excluded) is null where none does. Frames of
    different sizes differ everywhere.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(DIFF)
    def run(first: pd.Series, second: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = []
        for p, q, w in zip(first, second, width):
            n = len(p) // 4
            if q is None or len(p) != len(q):
                out.append((n, 255, 0, 0, int(w), n // int(w), n))
                continue
            x, y = (np.frombuffer(v, np.uint8).reshape(-1, int(w), 4)[:, :, :3].astype(np.int16) for v in (p, q))
            delta = np.abs(x - y).max(axis=2)
            ys, xs = np.nonzero(delta > tolerance)
            box = (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(ys) else (None,) * 4
            out.append((len(ys), int(delta.max(initial=0)), *box, n))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DIFF.split(", ")]).astype({c: "Int32" for c in ("left", "top", "right", "bottom")})

    return frames.select(*by, run(a, b, "width").alias("d")).select(*by, "d.*")


def png(width, height, bgra):
    """PNG images of frames."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def run(w: pd.Series, h: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([codec.png(int(a), int(b), c) for a, b, c in zip(w, h, data)])

    return run(width, height, bgra)


def desktop(frames: DataFrame, monitors: DataFrame) -> DataFrame:
    """(x, y, w, h, parts): the box around the monitors and the number of frames in it."""
    placed = frames.join(monitors.select("monitor_id", "x", "y"), "monitor_id")
    left, top = F.min("x"), F.min("y")
    return placed.agg(left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("width")) - left).alias("w"), (F.max(F.col("y") + F.col("height")) - top).alias("h"), F.count("*").alias("parts"))
