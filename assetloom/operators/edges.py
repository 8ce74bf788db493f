"""Edges of pixel values, smoothing before them, and distances to them."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.columns import ratio
from assetloom.operators.regions import label
from assetloom.operators.windows import AXES, line_window
from assetloom.session import cut

#: Thresholds of the gradient for outlines of masks that are 0 and 255.
LOW, HIGH = 50, 150
#: tan(22.5 degrees): up to it, or from its inverse on, a gradient counts as level or upright.
_LEVEL, _UPRIGHT = math.sqrt(2) - 1, math.sqrt(2) + 1


def gaussian(sigma: float) -> list[float]:
    """The kernel's weights, which add up to 1, out to four sigmas."""
    radius = int(round(8 * sigma + 1) | 1) // 2
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def convolve(px: DataFrame, value: str, kernel: list[float], out: str) -> DataFrame:
    """Adds ``value`` weighted by a kernel of odd length along the rows, then the columns.

    Lines go on beyond the image mirrored at their last pixel, as rows of their own while they are needed. Sides not
    longer than the kernel's radius have too few pixels for that; what is missing there is the pixel itself.
    """
    radius, own = len(kernel) // 2, px.columns
    df = px.withColumn(out, F.col(value).cast("double"))
    for line, along in AXES:
        last = px.groupBy("image").agg(F.max(along).alias("cv_last"))
        at = F.col(along)
        beyond = F.filter(F.array(at, -at, 2 * F.col("cv_last") - at), lambda p: (p == at) | ((p < 0) & (p >= -radius)) | ((p > F.col("cv_last")) & (p <= F.col("cv_last") + radius)))
        padded = df.join(last, "image").withColumn("cv_at", F.explode(F.array_distinct(beyond)))
        w = Window.partitionBy("image", line).orderBy("cv_at")
        near = lambda k: F.col(out) if k == 0 else F.coalesce((F.lag if k < 0 else F.lead)(out, abs(k)).over(w), F.col(out))
        total = sum((F.lit(weight) * near(k - radius) for k, weight in enumerate(kernel)), F.lit(0.0))
        df = padded.withColumn(out, total).where(F.col("cv_at") == at).select(*own, out)
    return df


def slopes(px: DataFrame, value: str) -> DataFrame:
    """Adds gx and gy, the Sobel slopes, the frame's pixels repeated outwards."""

    def pass_(df, source, out, axis, weights):
        w, own = line_window(*axis), F.col(source)
        return df.withColumn(out, weights[0] * F.coalesce(F.lag(own).over(w), own) + weights[1] * own + weights[2] * F.coalesce(F.lead(own).over(w), own))

    smooth, slope = (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0)
    df = pass_(pass_(px, value, "gx", AXES[0], slope), value, "gy", AXES[0], smooth)
    return pass_(pass_(df, "gx", "gx", AXES[1], smooth), "gy", "gy", AXES[1], slope)


def edges(px: DataFrame, value: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(image, y, x) of edges one pixel wide: where the slope is largest across them, above ``low``, and in one piece
    with a pixel above ``high``."""
    row, column = line_window(*AXES[0]), line_window(*AXES[1])
    df = slopes(px, value).select("image", "y", "x", "gx", "gy", (F.abs("gx") + F.abs("gy")).alias("m"))
    df = df.withColumns({"ml": F.lag("m").over(row), "mr": F.lead("m").over(row)})
    sides = {"l": F.col("ml"), "r": F.col("mr")} | {f"{way}{c[1:]}": f(c).over(column) for way, f in (("u", F.lag), ("d", F.lead)) for c in ("m", "ml", "mr")}
    df = df.withColumns({f"near_{k}": F.coalesce(v, F.lit(0.0)) for k, v in sides.items()})
    near, steep = (lambda k: F.col(f"near_{k}")), F.abs("gy")
    falling = F.col("gx") * F.col("gy") >= 0
    largest = (
        F.when(steep <= _LEVEL * F.abs("gx"), (F.col("m") > near("l")) & (F.col("m") >= near("r")))
        .when(steep >= _UPRIGHT * F.abs("gx"), (F.col("m") > near("u")) & (F.col("m") >= near("d")))
        .when(falling, (F.col("m") > near("ul")) & (F.col("m") > near("dr")))
        .otherwise((F.col("m") > near("ur")) & (F.col("m") > near("dl")))
    )
    thin = cut(df.where((F.col("m") > low) & largest).select("image", "y", "x", "m"))
    labelled = label(thin.withColumn("thin", F.lit(1)), "thin")
    strong = labelled.join(thin.where(F.col("m") > high), ["image", "y", "x"]).select("image", "component").distinct()
    return labelled.join(strong, ["image", "component"], "left_semi").select("image", "y", "x")


# --- distances

def nearest_squares(xs: list[int], heights: list[int], n: int) -> list[int]:
    """For each of the places 0 to n - 1 the least (place - x)^2 + height over ascending x.

    The lower envelope of parabolas as a stack: a new one takes off those that it lies below wherever
    they were lowest.
    """
    stack: list[tuple[int, int, float]] = []  # a parabola and the place from which it is lowest
    for x, h in zip(xs, heights, strict=True):
        begin = -math.inf
        while stack:
            x0, h0, begin0 = stack[-1]
            begin = ((h + x * x) - (h0 + x0 * x0)) / (2 * (x - x0))
            if begin > begin0:
                break
            stack.pop()
            begin = -math.inf
        stack.append((x, h, begin))
    out, k = [], 0
    for place in range(n):
        while k + 1 < len(stack) and stack[k + 1][2] <= place:
            k += 1
        out.append((place - stack[k][0]) ** 2 + stack[k][1])
    return out


def _square_batches(batches):
    for batch in batches:
        lines = [nearest_squares(*zip(*sorted(zip(xs, hs, strict=True)), strict=True), n) for xs, hs, n in zip(*(batch.column(c).to_pylist() for c in ("xs", "heights", "n")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("y"), pa.array(lines, pa.list_(pa.int64()))], ["image", "y", "squares"])


def squared_distances(px: DataFrame, mask: str) -> DataFrame:
    """(image, y, x, squared): the exact squared distance of every pixel to the nearest pixel of the mask (its own: 0);
    null in images without one. Images are whole: y and x run from 0.

    Down the columns the nearest mask pixel is a running value both ways; along a row the columns'
    distances are parabolas, whose lower envelope a stack finds.
    """
    down, up = line_window("x", "y"), Window.partitionBy("image", "x").orderBy(F.col("y").desc())
    own = F.when(F.col(mask) == 1, F.col("y"))
    near = lambda w: F.abs(F.col("y") - F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tall = px.select("image", "y", "x", mask).withColumn("above", near(down)).withColumn("height", F.least("above", near(up)).cast("long"))
    square = F.col("height") * F.col("height")
    lines = tall.groupBy("image", "y").agg(F.collect_list(F.when(square.isNotNull(), F.col("x").cast("long"))).alias("xs"), F.collect_list(square).alias("heights"), (F.max("x") + 1).cast("long").alias("n"))
    kind = px.schema["image"].dataType.simpleString()
    found = lines.where("size(xs) > 0").select("image", F.col("y").cast("long").alias("y"), "xs", "heights", "n").mapInArrow(_square_batches, f"image {kind}, y long, squares array<long>")
    each = found.select("image", "y", F.posexplode("squares").alias("x", "squared"))
    # Without a mask pixel no line of the image has any.
    none = lines.where("size(xs) = 0").select("image", F.col("y").cast("long").alias("y"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("x"), F.lit(None).cast("long").alias("squared"))
    return each.union(none)


def edge_f1(px: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """(image, edge_f1) of two masks (0 or 1): an edge pixel is matched if the other mask's edge passes within a circle of
    ``tolerance`` around it. 1 for two masks without edges, 0 if only one has any."""
    sums = px.select("image").distinct()
    found = {k: cut(edges(px.withColumn("edge_value", 255.0 * F.col(c)), "edge_value")) for k, c in (("a", a), ("b", b))}
    for own, other in (("a", "b"), ("b", "a")):
        marked = px.select("image", "y", "x").join(found[other].withColumn("on", F.lit(1)), ["image", "y", "x"], "left").na.fill(0, ["on"])
        near = squared_distances(marked, "on").where(F.col("squared") <= tolerance * tolerance)
        hit = found[own].join(near, ["image", "y", "x"], "left_semi").groupBy("image").agg(F.count("*").alias(f"hit_{own}"))
        sums = sums.join(found[own].groupBy("image").agg(F.count("*").alias(own)), "image", "left").join(hit, "image", "left")
    sums = sums.na.fill(0)
    p, r = ratio(F.col("hit_a"), F.col("a")), ratio(F.col("hit_b"), F.col("b"))
    f1 = F.when((F.col("a") == 0) & (F.col("b") == 0), 1.0).when((F.col("a") == 0) | (F.col("b") == 0) | (p + r == 0), 0.0).otherwise(ratio(2 * p * r, p + r))
    return sums.select("image", f1.alias("edge_f1"))
