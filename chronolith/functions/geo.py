"""Grid expressions; cells floor, so negative pixels fall left and above."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(x, tile: int):
    return F.floor(x / tile).cast("int")


def dirty_cells(rects: DataFrame, tile: int, key: str) -> DataFrame:
    """(key, cx, cy): distinct cells that rectangles (x, y, w, h) touch; empty ones touch none."""
    r = rects.filter("w > 0 and h > 0").select(key, F.explode(F.sequence(cell(F.col("x"), tile), cell(F.col("x") + F.col("w") - 1, tile))).alias("cx"), "y", "h")
    return r.select(key, "cx", F.explode(F.sequence(cell(F.col("y"), tile), cell(F.col("y") + F.col("h") - 1, tile))).alias("cy")).distinct()


def dense_index(cx, cy, origin_x, origin_y, columns, rows):
    """Index of a cell in a monitor's grid, -1 outside."""
    inside = (cx >= origin_x) & (cx < origin_x + columns) & (cy >= origin_y) & (cy < origin_y + rows)
    return F.when(inside, (cy - origin_y) * columns + cx - origin_x).otherwise(-1)


def scaled(x, y, w, h, scale):
    """Rectangle in other units: origin floored, far edge raised."""
    left, top = F.floor(x * scale), F.floor(y * scale)
    return left, top, F.ceil((x + w) * scale) - left, F.ceil((y + h) * scale) - top


def moved(moves: DataFrame, key: str) -> DataFrame:
    """(key, x, y, w, h): the rectangles that moves (x, y, w, h, from_x, from_y) change, where they go and where they came
    from; a move of no size or to its own place changes none."""
    real = moves.filter("w > 0 and h > 0 and (x <> from_x or y <> from_y)")
    ends = F.array(F.struct("x", "y"), F.struct(F.col("from_x").alias("x"), F.col("from_y").alias("y")))
    return real.select(key, F.explode(ends).alias("at"), "w", "h").select(key, "at.x", "at.y", "w", "h")


def pack(cx, cy):
    return F.shiftleft(cx.cast("long"), 32).bitwiseOR(cy.cast("long").bitwiseAND(0xFFFFFFFF))


def unpack(packed):
    return F.shiftright(packed, 32).cast("int"), packed.cast("int")


def grid(x, y, w, h, tile: int):
    """(origin_x, origin_y, columns, rows) in cells of a monitor at pixels (x, y) of size w x h."""
    left, top = cell(x, tile), cell(y, tile)
    return left, top, cell(x + w - 1, tile) - left + 1, cell(y + h - 1, tile) - top + 1


def cell_of(idx, origin_x, origin_y, columns):
    """Cell of a dense index."""
    return idx % columns + origin_x, F.floor(idx / columns) + origin_y


def clipped(cx, cy, x, y, w, h, tile: int):
    """Pixels (left, top, width, height) of a cell inside its monitor; a size of 0 lies outside."""
    left, top = F.greatest(cx * tile, x), F.greatest(cy * tile, y)
    wide, high = F.least((cx + 1) * tile, x + w) - left, F.least((cy + 1) * tile, y + h) - top
    return left, top, F.greatest(wide, F.lit(0)), F.greatest(high, F.lit(0))


def bounding_box(rects: DataFrame, *by: str) -> DataFrame:
    """(by, x, y, w, h): the smallest rectangle around all, such as a desktop of several monitors."""
    left, top = F.min("x"), F.min("y")
    return rects.groupBy(*by).agg(left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("w")) - left).alias("w"), (F.max(F.col("y") + F.col("h")) - top).alias("h"))


def readback(rects: DataFrame, frame: str, width: int, height: int, x: int, y: int, tile: int, most: int = 8, share: float = 0.5) -> DataFrame:
    """(frame, plan, regions, covered, left, top, right, bottom): what to copy of a surface for its changed rectangles.

    Rectangles (x, y, w, h) in surface pixels grow to whole tiles. At most ``most`` of them that cover no more than
    ``share`` of the surface (overlaps count twice) are copied alone ('parts'); else their bounding box, if no larger than
    that ('box'); else everything ('full'), also for a rectangle outside the surface and a frame without any.
    """
    rx, ry, rw, rh = (F.col(c) for c in "xywh")
    empty = (rw <= 0) | (rh <= 0)
    outside = ~empty & ((rx < 0) | (ry < 0) | (rx + rw > width) | (ry + rh > height))
    left, top = F.greatest(F.lit(0), cell(rx + x, tile) * tile - x), F.greatest(F.lit(0), cell(ry + y, tile) * tile - y)
    right = F.least(F.lit(width), (cell(rx + x + rw - 1, tile) + 1) * tile - x)
    bottom = F.least(F.lit(height), (cell(ry + y + rh - 1, tile) + 1) * tile - y)
    r = rects.select(frame, outside.alias("out"), (~empty & ~outside & (right > left) & (bottom > top)).alias("ok"), left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))
    only = lambda c: F.when(F.col("ok"), F.col(c))
    area = F.when(F.col("ok"), ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).cast("long"))
    g = r.groupBy(frame).agg(
        F.max("out").alias("out"), F.count_if("ok").alias("regions"), F.coalesce(F.sum(area), F.lit(0)).alias("covered"),
        F.min(only("l")).alias("left"), F.min(only("t")).alias("top"), F.max(only("r")).alias("right"), F.max(only("b")).alias("bottom"),
    )
    limit = width * height * share
    box = (F.col("right") - F.col("left")).cast("long") * (F.col("bottom") - F.col("top"))
    plan = F.when(F.col("out") | (F.col("regions") == 0), "full").when((F.col("regions") <= most) & (F.col("covered") <= limit), "parts").when(box <= limit, "box").otherwise("full")
    return g.select(frame, plan.alias("plan"), "regions", "covered", "left", "top", "right", "bottom")
