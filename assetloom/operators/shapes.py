"""Shapes of regions from runs along rows: areas inside outlines, convex hulls, rectangles, quadrilaterals.

A region is its runs (image, component, y, x0, x1), far fewer than its pixels. Outlines and hulls pass through
the centres of pixels, so a rectangle of w x h pixels has the area (w - 1)(h - 1). What is collected for a region is
two numbers a row, bounded by the image's height.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.columns import let, ratio
from assetloom.operators.windows import line_window
from assetloom.session import cut

POINTS = "array<struct<y:double,x:double>>"
#: Shares of the outline's length by which a simplified hull may miss its points.
TOLERANCES = (0.01, 0.02, 0.03, 0.05, 0.08)
#: What a rectangle around the hull is worth where no four corners were found.
RECTANGLE_WORTH = 0.8


# --- largest rectangle

def widest_under(xs: list[int], heights: list[int]) -> tuple[int, int, int, int]:
    """The largest rectangle under bars at ascending x: area, -x, width, height; the leftmost of equal ones.

    A stack holds the bars that may still grow, each from the leftmost place it reaches; a lower bar
    or a gap ends higher ones. Every bar is put on and taken off once.
    """
    best, stack, past = (0, 0, 0, 0), [], 0

    def ended(height: int, at: int) -> int:
        nonlocal best
        start = at
        while stack and stack[-1][1] >= height:
            start, own = stack.pop()
            best = max(best, (own * (at - start), -start, at - start, own))
        return start

    for x, height in zip(xs, heights, strict=True):
        if x != past:
            ended(0, past)
        stack.append((ended(height, x), height))
        past = x + 1
    ended(0, past)
    return best


def _rectangle_batches(batches):
    for batch in batches:
        lines = [widest_under(*zip(*sorted(bars.items()), strict=True)) for bars in map(dict, zip_lists(batch))]
        area, left, width, height = (pa.array(c, pa.int64()) for c in zip(*lines, strict=True)) if lines else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("y"), area, left, width, height], ["image", "y", "area", "left", "width", "height"])


def zip_lists(batch):
    return (zip(xs, heights, strict=True) for xs, heights in zip(batch.column("xs").to_pylist(), batch.column("heights").to_pylist(), strict=True))


def largest_rectangle(px: DataFrame, mask: str) -> DataFrame:
    """(image, area, x, y, width, height) of the largest upright rectangle inside the mask, the topmost, then
    leftmost, of equal ones; images without mask pixels give no row.

    A pixel's height is the length of the run that ends at it, down its column. A line's heights, one
    array, go through a stack once.
    """
    down = line_window("x", "y")
    high = px.withColumn("line", F.row_number().over(down)).withColumn("height", F.col("line") - F.coalesce(F.max(F.when(F.col(mask) == 0, F.col("line"))).over(down.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    lines = high.where("height > 0").groupBy("image", "y").agg(F.collect_list(F.col("x").cast("long")).alias("xs"), F.collect_list(F.col("height").cast("long")).alias("heights"))
    kind = px.schema["image"].dataType.simpleString()
    found = lines.select("image", F.col("y").cast("long").alias("y"), "xs", "heights").mapInArrow(_rectangle_batches, f"image {kind}, y long, area long, left long, width long, height long")
    best = found.groupBy("image").agg(F.max(F.struct("area", (F.col("height") - F.col("y") - 1).alias("top"), "left", "width", "height")).alias("b"))
    return best.select("image", "b.area", (-F.col("b.left")).alias("x"), (-F.col("b.top")).alias("y"), "b.width", "b.height")


# --- outlines and hulls

def outline_areas(runs: DataFrame) -> DataFrame:
    """(image, component, outlined): the area inside the outline through the pixels' centres, of filled runs.

    Each square of four neighbouring centres counts 1 if all are in, 1/2 if three are. Those of two rows lie where
    runs overlap: an overlap of k columns has k - 1 full squares, and half a square at each end where one run goes on.
    """
    below = runs.select("image", "component", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    met = runs.join(below, ["image", "component", "y"]).where((F.col("x0") <= F.col("b1")) & (F.col("b0") <= F.col("x1")))
    ends = (F.col("x0") != F.col("b0")).cast("int") + (F.col("x1") != F.col("b1")).cast("int")
    squares = F.least("x1", "b1") - F.greatest("x0", "b0") + ends / 2.0
    return met.groupBy("image", "component").agg(F.sum(squares).alias("outlined"))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["y"] - a["y"]) * (c["x"] - a["x"]) - (b["x"] - a["x"]) * (c["y"] - a["y"])


def _chain(points: Column, side: int) -> Column:
    """One side of the hull of points with ascending y (side 1: left, -1: right).

    Monotone chain as a fold: a new point takes off the points at the end that it leaves inside. On a
    convex chain these are all whose turn to the new point has the wrong sign.
    """

    def add(chain, p):
        kept = F.filter(chain, lambda h, i: (i == 0) | (_turn(F.get(chain, i - 1), h, p) * side > 0))
        return F.array_append(kept, p)

    return F.aggregate(points, F.array().cast(POINTS), add)


def hulls(runs: DataFrame) -> DataFrame:
    """(image, component, hull): the corners of the convex hull, down the left side and up the right one."""
    rows = runs.groupBy("image", "component", "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    point = lambda c: F.struct(F.col("y").cast("double").alias("y"), F.col(c).cast("double").alias("x"))
    sides = rows.groupBy("image", "component").agg(*[F.array_sort(F.collect_list(point(c))).alias(k) for k, c in (("l", "x0"), ("r", "x1"))])
    return sides.select("image", "component", F.array_distinct(F.concat(_chain(F.col("l"), 1), F.reverse(_chain(F.col("r"), -1)))).alias("hull"))


def _length(dy: Column, dx: Column) -> Column:
    return F.sqrt(dy * dy + dx * dx)


def _neighbour(points: Column, i: Column, by: int) -> Column:
    return F.get(points, F.pmod(i + by, F.size(points)))


def polygon_area(points: Column) -> Column:
    """By the shoelace formula."""
    cross = F.transform(points, lambda p, i: p["y"] * _neighbour(points, i, 1)["x"] - p["x"] * _neighbour(points, i, 1)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2


def polygon_length(points: Column) -> Column:
    steps = F.transform(points, lambda p, i: _length(_neighbour(points, i, 1)["y"] - p["y"], _neighbour(points, i, 1)["x"] - p["x"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def solidity(runs: DataFrame) -> DataFrame:
    """(image, component, solidity): the share of the convex hull that lies inside the outline, of filled runs; 0
    where the hull has no area. A rectangle has 1."""
    both = cut(hulls(runs)).join(outline_areas(runs), ["image", "component"], "left")
    share = let(polygon_area(F.col("hull")), lambda around: F.coalesce(F.try_divide(F.col("outlined"), around), F.lit(0.0)))
    return both.select("image", "component", share.alias("solidity"))


# --- quadrilaterals

def least_rectangle(hull: Column) -> Column:
    """The corners of the least rectangle around a hull: one of its sides lies along one of the hull's.

    Fewer than three corners have none: null. Of equal rectangles the first side's is taken.
    """

    def along(p, i):
        q = _neighbour(hull, i, 1)
        return let(F.struct((q["y"] - p["y"]).alias("y"), (q["x"] - p["x"]).alias("x"), _length(q["y"] - p["y"], q["x"] - p["x"]).alias("n")), lambda d: F.struct(i.alias("i"), (d["y"] / d["n"]).alias("uy"), (d["x"] / d["n"]).alias("ux")))

    def around(d):
        u, v = F.transform(hull, lambda h: h["y"] * d["uy"] + h["x"] * d["ux"]), F.transform(hull, lambda h: h["x"] * d["uy"] - h["y"] * d["ux"])
        ends = F.struct(F.array_min(u).alias("u0"), F.array_max(u).alias("u1"), F.array_min(v).alias("v0"), F.array_max(v).alias("v1"))
        return let(ends, lambda e: F.struct(((e["u1"] - e["u0"]) * (e["v1"] - e["v0"])).alias("area"), d["i"].alias("i"), d["uy"].alias("uy"), d["ux"].alias("ux"), *[e[k].alias(k) for k in ("u0", "u1", "v0", "v1")]))

    def corners(best):
        corner = lambda u, v: F.struct((best[u] * best["uy"] - best[v] * best["ux"]).alias("y"), (best[u] * best["ux"] + best[v] * best["uy"]).alias("x"))
        return F.array(corner("u0", "v0"), corner("u1", "v0"), corner("u1", "v1"), corner("u0", "v1"))

    return F.when(F.size(hull) > 2, let(F.array_min(F.transform(F.transform(hull, along), around)), corners))


def _flatness(points: Column) -> Column:
    """Each corner's distance from the line through its neighbours."""

    def of(p, i):
        a, b = _neighbour(points, i, -1), _neighbour(points, i, 1)
        return F.coalesce(F.abs(_turn(a, p, b)) / F.nullif(_length(b["y"] - a["y"], b["x"] - a["x"]), F.lit(0.0)), F.lit(0.0))

    return F.transform(points, of)


def four_corners(hull: Column) -> Column:
    """A hull's four corners, where dropping flat corners leaves just four at one of TOLERANCES; else null.

    The flattest corner goes first, the first of equal ones. The hull fits a tolerance if all corners
    dropped were flatter and none of the four is.
    """

    def drop(state, _):
        found = lambda flat: let(F.array_min(flat), lambda least: F.struct(least.alias("least"), F.array_position(flat, least).alias("at")))
        return let(let(_flatness(state["points"]), found), lambda f: F.struct(F.filter(state["points"], lambda p, i: i != f["at"] - 1).alias("points"), F.greatest(state["cost"], f["least"]).alias("cost")))

    def chosen(last):
        measures = F.struct(last["cost"].alias("cost"), F.array_min(_flatness(last["points"])).alias("next"), polygon_length(hull).alias("length"))
        fits = lambda m: reduce(lambda a, b: a | b, [(m["cost"] <= t * m["length"]) & (m["next"] > t * m["length"]) for t in TOLERANCES])
        return F.when(let(measures, fits), last["points"])

    start = F.struct(hull.cast(POINTS).alias("points"), F.lit(0.0).alias("cost"))
    turns = F.when(F.size(hull) > 4, F.sequence(F.lit(5), F.size(hull))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(hull) >= 4, let(F.aggregate(turns, start, drop), chosen))


def _spans(quads: DataFrame) -> DataFrame:
    """(image, y, s0, s1): the columns of each row that lie in a convex quadrilateral, its border included."""
    q = F.col("quad")
    low, high = F.ceil(F.array_min(F.transform(q, lambda p: p["y"])) - 1e-9), F.floor(F.array_max(F.transform(q, lambda p: p["y"])) + 1e-9)
    rows = quads.where(low <= high).select("image", "quad", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("y"))
    y = F.col("y").cast("double")

    def crossing(p, i):
        def of(b):
            low, high = F.least(p["y"], b["y"]), F.greatest(p["y"], b["y"])
            at = p["x"] + (b["x"] - p["x"]) * (F.least(F.greatest(y, low), high) - p["y"]) / F.nullif(b["y"] - p["y"], F.lit(0.0))
            xs = F.when(high - low < 1e-9, F.array(p["x"], b["x"])).otherwise(F.array(at))
            return F.when((low <= y + 1e-9) & (high >= y - 1e-9), xs).otherwise(F.array().cast("array<double>"))

        return let(_neighbour(q, i, 1), of)

    xs = F.flatten(F.transform(q, crossing))
    return rows.select("image", "y", let(xs, lambda c: F.struct(F.ceil(F.array_min(c) - 1e-9).alias("s0"), F.floor(F.array_max(c) + 1e-9).alias("s1"))).alias("s")).select("image", "y", "s.*").where("s0 <= s1")


def quad_fit(runs: DataFrame) -> DataFrame:
    """(image, quad, quad_fit) for runs of one region an image: the quadrilateral that its hull simplifies to, else
    the least rectangle around it, and the share of the union of both that both cover, less for a rectangle."""
    found = cut(hulls(runs)).withColumns({"four": four_corners(F.col("hull")), "rectangle": least_rectangle(F.col("hull"))})
    quads = found.select("image", F.coalesce("four", "rectangle").alias("quad"), F.when(F.col("four").isNotNull(), 1.0).otherwise(RECTANGLE_WORTH).alias("worth"))
    spans = _spans(quads.where("quad is not null"))
    inside = spans.groupBy("image").agg(F.sum(F.col("s1") - F.col("s0") + 1).alias("in_quad"))
    shared = runs.select("image", F.col("y").cast("long").alias("y"), "x0", "x1").join(spans, ["image", "y"])
    shared = shared.groupBy("image").agg(F.sum(F.greatest(F.lit(0), F.least("x1", "s1") - F.greatest("x0", "s0") + 1)).alias("both"))
    own = runs.groupBy("image").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    met = quads.join(own, "image").join(inside, "image", "left").join(shared, "image", "left").na.fill(0, ["in_quad", "both"])
    return met.select("image", "quad", (F.col("worth") * ratio(F.col("both"), F.col("area") + F.col("in_quad") - F.col("both"))).alias("quad_fit"))
