"""Layers of light under a design: shading, displacement and a cut-out without fringes.

Smoothing is done on a coarse grid of cells over places (and levels of value, where edges must stay): a pixel gives its
sums to the cells around it, the cells are blurred, and each pixel reads its cells back. The cost doesn't
grow with the width of the smoothing, which may differ from image to image.
"""

from __future__ import annotations

import itertools
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetloom.functions.columns import clip, luminance
from assetloom.operators.evaluation import percentiles
from assetloom.operators.pixels import dilate, lab, last_places
from assetloom.operators.windows import AXES, line_window
from assetloom.session import cut

#: A Gaussian cut off at 1.5 sigmas around a pixel spreads like a whole one of this share of the sigma.
CUT_OFF = 0.68
#: What is least taken for a weight in a mean, as a share of the pixels' number.
LEAST_WEIGHT = 1e-4
NEUTRAL = 128
#: Pixels of small images that one task takes, and the most that an image may have for being one task's.
PIXELS_AT_ONCE, LARGE = 1 << 15, 1 << 20


def grid_means(px: DataFrame, values: dict[str, Column], weight: Column, space: Column, level: Column | None = None) -> DataFrame:
    """Adds weighted means over what is near: within about ``space`` pixels and, with ``level``, about 1 in that value.

    Cells are ``space`` wide (and 1 in level). Linear shares into two cells an axis, sums over three
    and linear reading have together the variance of a Gaussian whose sigma is a cell. Places beyond the image don't
    count. Nulls in values, weights or levels are not allowed.
    """
    own = px.columns
    at = {"gm_y": F.col("y") / space, "gm_x": F.col("x") / space} | ({"gm_v": level} if level is not None else {})
    sums = {"gm_n": F.lit(1.0), "gm_d": weight.cast("double")} | {f"gm_s{i}": weight * v for i, v in enumerate(values.values())}
    placed = px.withColumns({f"{k}_at": v.cast("double") for k, v in at.items()} | sums).withColumns({k: F.floor(f"{k}_at").cast("long") for k in at})
    corners = list(itertools.product((0, 1), repeat=len(at)))

    def share(corner):
        parts = [F.col(f"{k}_at") - F.col(k) if up else 1 - (F.col(f"{k}_at") - F.col(k)) for k, up in zip(at, corner, strict=True)]
        return reduce(lambda a, b: a * b, parts)

    def moved(steps, sign):
        return [(F.col(k) + sign * step).alias(k) for k, step in zip(at, steps, strict=True)]

    def summed(df, cells):
        return df.select("image", F.explode(F.array(*cells)).alias("c"), *sums).select("image", "c.*", *sums)

    # A cell's pixels are summed before their shares are dealt to its corners.
    own_cells = placed.groupBy("image", *at).agg(*[F.sum(share(c) * F.col(k)).alias(f"{k}_{i}") for i, c in enumerate(corners) for k in sums])
    dealt = [F.struct(*moved(c, 1), *[F.col(f"{k}_{i}").alias(k) for k in sums]) for i, c in enumerate(corners)]
    cells = own_cells.select("image", F.explode(F.array(*dealt)).alias("c")).select("image", "c.*").groupBy("image", *at).agg(*[F.sum(k).alias(k) for k in sums])
    # One axis after the other: three rows a cell each time.
    for axis in at:
        steps = [[step if k == axis else 0 for k in at] for step in (-1, 0, 1)]
        cells = summed(cells, [F.struct(*moved(c, 1)) for c in steps]).groupBy("image", *at).agg(*[F.sum(k).alias(k) for k in sums])
    # What lies in a cell reads all its corners from one row.
    asked = own_cells.select("image", F.explode(F.array(*[F.struct(*[F.col(k).alias(f"own_{k}") for k in at], *moved(c, 1), F.lit(i).alias("gm_k")) for i, c in enumerate(corners)])).alias("c")).select("image", "c.*")
    beside = asked.join(cells, ["image", *at]).select("image", *[F.col(f"own_{k}").alias(k) for k in at], "gm_k", *sums)
    blocks = beside.groupBy("image", *at).agg(*[F.sum(F.when(F.col("gm_k") == i, F.col(k))).alias(f"{k}_{i}") for i in range(len(corners)) for k in sums])
    read = {k: sum((share(c) * F.col(f"{k}_{i}") for i, c in enumerate(corners)), F.lit(0.0)) for k in sums}
    below = F.greatest(read["gm_d"], LEAST_WEIGHT * read["gm_n"])
    met = placed.join(blocks, ["image", *at])
    return met.select(*[c for c in own if c not in values], *[(read[f"gm_s{i}"] / below).alias(k) for i, k in enumerate(values)])


def _together(px: DataFrame) -> DataFrame:
    """The pixels of an image in one task, many images in each, so that sums, blurs and reads need no exchange of their
    own; more tasks for more pixels. If an image has more than ``LARGE`` pixels, nothing is moved."""
    n, largest = px.groupBy("image").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if not n or largest > LARGE:
        return px
    return px.repartition(max(int(px.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PIXELS_AT_ONCE + 1), "image")


@contextmanager
def _joined_in_place(spark: SparkSession):
    """Plans that are made and run inside join rows where they lie, if both sides lie by some of the keys.

    Spark would else move all pixels for each join, to lie by all of its keys.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, False)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bilateral(px: DataFrame, value: str, space: Column, spread: float, out: str) -> DataFrame:
    """Smooths ``value`` over near pixels of like value: sigmas ``space`` in places and ``spread`` in value."""
    return grid_means(px, {out: F.col(value)}, F.lit(1.0), space, F.col(value) / spread)


def _lit_pixels(px: DataFrame, alpha: str) -> DataFrame:
    """Adds ly_light (0 to 1), ly_a and ly_long, the longer side."""
    px = _together(px)
    sides = last_places(px).select("image", (F.greatest("h", "w") + 1).cast("double").alias("ly_long"))
    lit = lab(px).withColumns({"ly_light": luminance(F.col("L")), "ly_a": clip(F.col(alpha).cast("double"))}).drop("L", "a", "b_")
    return lit.join(sides, "image")


def _enough(px: DataFrame, least: float) -> DataFrame:
    return px.groupBy("image").agg((F.sum("ly_a") >= least).alias("ly_enough"))


def light_layers(px: DataFrame, alpha: str, strength: float = 1.0, least: float = 64) -> DataFrame:
    """Adds shadow and highlight, 0 to 1: how much darker or lighter than the object's own tone a pixel is.

    px: image, y, x, r, g, b (0 to 255) and ``alpha`` (0 to 1). The tone is the light smoothed over the object; what is left,
    smoothed within edges, is scaled by the 99th percentile over the body (alpha above 0.5). Images whose
    alpha adds up to less than ``least`` get 0. Rows with nulls in these columns are not allowed.
    """
    lit = _lit_pixels(px, alpha)
    tone = grid_means(lit, {"ly_tone": F.col("ly_light")}, F.col("ly_a"), F.greatest(F.lit(6.0), 0.08 * F.col("ly_long")))
    # Two stages: each sum, sort and join of a stage holds memory of its own.
    with _joined_in_place(px.sparkSession):
        shading = _together(cut(tone.withColumn("ly_left", F.col("ly_light") / F.greatest(F.col("ly_tone"), F.lit(0.02)))))
    space = F.greatest(F.lit(3.0), 0.004 * F.col("ly_long")) * CUT_OFF
    smooth = bilateral(shading, "ly_left", space, 0.08, "ly_left")
    with _joined_in_place(px.sparkSession):
        raw = cut(smooth.withColumns({"shadow": clip((1 - F.col("ly_left")) * strength), "highlight": clip((F.col("ly_left") - 1) * strength)}))
    out = raw.join(_enough(raw, least), "image")
    body = raw.where("ly_a > 0.5")
    for c in ("shadow", "highlight"):
        top = percentiles(body, c, ["image"], {f"ly_top_{c}": 0.99})
        scale = F.when(F.col(f"ly_top_{c}") > 1e-3, F.col(f"ly_top_{c}")).otherwise(1.0)
        out = out.join(top, "image", "left").withColumn(c, F.when(F.col("ly_enough"), clip(F.col(c) / scale) * F.col("ly_a")).otherwise(0.0))
    return out.select(*px.columns, "shadow", "highlight")


def light_report(layers: DataFrame, alpha: str) -> DataFrame:
    """(image, albedo_sigma_px, shadow_mean, highlight_mean) over the body; means are 0 without one."""
    on = F.col(alpha) > 0.5
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(0.0)), 4).alias(f"{c}_mean")
    long = F.greatest(F.max("y"), F.max("x")) + 1
    return layers.groupBy("image").agg(F.round(F.greatest(F.lit(6.0), 0.08 * long), 1).alias("albedo_sigma_px"), mean("shadow"), mean("highlight"))


def displacement(px: DataFrame, alpha: str, gain: float = 1.0, least: float = 64) -> DataFrame:
    """Adds displacement, 0 to 255: folds of middle size around NEUTRAL, which is also what lies outside the body.

    px as for ``light_layers``. The light, smoothed within edges, less its mean over the object is scaled by the 98th
    percentile of its size. Images whose alpha adds up to less than ``least`` are neutral.
    """
    long = F.col("ly_long")
    # The smoothing's width is an odd number of pixels, 3 at least.
    odd = F.floor(0.0025 * long)
    space = F.greatest(F.lit(3.0), odd + 1 - odd % 2) * CUT_OFF
    smooth = bilateral(_lit_pixels(px, alpha), "ly_light", space, 0.06, "ly_smooth")
    based = grid_means(smooth, {"ly_base": F.col("ly_smooth")}, F.col("ly_a"), F.greatest(F.lit(4.0), 0.03 * long))
    left = cut(based.withColumn("ly_left", F.col("ly_smooth") - F.col("ly_base")).withColumn("ly_size", F.abs("ly_left")))
    top = percentiles(left.where("ly_a > 0.5"), "ly_size", ["image"], {"ly_top": 0.98})
    out = left.join(_enough(left, least), "image").join(top, "image", "left")
    by = clip(F.col("ly_left") / F.greatest(F.col("ly_top"), F.lit(1e-3)) * gain, -1.0, 1.0) * F.col("ly_a")
    byte = clip(F.floor(F.round(by * 127 + NEUTRAL + 0.5, 9)).cast("double"), 0.0, 255.0).cast("int")
    return out.select(*px.columns, F.when(F.col("ly_enough") & (F.col("ly_a") > 0.5), byte).otherwise(NEUTRAL).alias("displacement"))


def nearest_marked(px: DataFrame, mask: str, carry: list[str], reach: int) -> DataFrame:
    """Adds near: (squared, y, x, and the columns ``carry``) of the nearest pixel of the mask, of equally near ones the first by
    y, then x; exact where one lies within ``reach``, else null or not the nearest.

    Up and down a column the nearest is a running value; of the columns within reach, the least is taken.
    """
    down, up = line_window("x", "y"), Window.partitionBy("image", "x").orderBy(F.col("y").desc())
    own = F.when(F.col(mask) == 1, F.struct("y", "x", *carry))
    last = lambda w: F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = px.withColumn("nm_above", last(down)).withColumn("nm_below", last(up))
    gap = lambda c: F.abs(F.col("y") - F.col(f"{c}.y"))
    nearer = F.when(F.col("nm_below").isNull() | (gap("nm_above") <= gap("nm_below")), F.col("nm_above")).otherwise(F.col("nm_below"))
    df = df.withColumn("nm_own", nearer).drop("nm_above", "nm_below")
    row = line_window(*AXES[0])
    beside = lambda k: F.col("nm_own") if k == 0 else (F.lead if k > 0 else F.lag)("nm_own", abs(k)).over(row)
    df = df.withColumns({f"nm_{k + reach}": beside(k) for k in range(-reach, reach + 1)})
    squared = lambda c: F.pow(F.col("y") - c["y"], 2) + F.pow(F.col("x") - c["x"], 2)
    parts = [F.col(f"nm_{i}") for i in range(2 * reach + 1)]
    each = [F.when(p.isNotNull(), F.struct(squared(p).cast("long").alias("squared"), p["y"].alias("y"), p["x"].alias("x"), *[p[c].alias(c) for c in carry])) for p in parts]
    return df.withColumn("near", F.least(*each)).select(*px.columns, "near")


def cut_out(px: DataFrame, alpha: str, wide: int = 6, least_core: int = 64, least_edge: int = 16) -> DataFrame:
    """Adds cut_r, cut_g, cut_b and cut_a (0 to 255): the object on nothing, its soft edge in the object's own colours.

    px as for ``light_layers``. Pixels with alpha between 0.01 and 0.85 within ``wide`` rows and columns of the core (alpha above
    0.85) take the colour of the nearest core pixel, of equally near ones the first by y, then x. Images with
    ``least_core`` core pixels or ``least_edge`` such pixels, or fewer, keep their colours.
    """
    a = clip(F.col(alpha).cast("double"))
    df = dilate(px.withColumn("co_core", (a > 0.85).cast("int")), "co_core", wide, "co_near")
    df = df.withColumn("co_need", ((a > 0.01) & (a < 0.85) & (F.col("co_near") == 1) & (F.col("co_core") == 0)).cast("int"))
    # A core pixel at a corner of the square is the square root of 2 farther than one at its side.
    df = cut(nearest_marked(df, "co_core", ["r", "g", "b"], int(wide * 2**0.5)))
    counts = df.groupBy("image").agg(((F.sum("co_core") > least_core) & (F.sum("co_need") > least_edge)).alias("co_do"))
    take = F.col("co_do") & (F.col("co_need") == 1)
    colours = [F.when(take, F.col(f"near.{c}")).otherwise(F.col(c)).cast("int").alias(f"cut_{c}") for c in "rgb"]
    return df.join(counts, "image").select(*px.columns, *colours, clip(F.floor(a * 255 + 0.5).cast("double"), 0.0, 255.0).cast("int").alias("cut_a"))
