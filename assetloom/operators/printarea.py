"""Where a product can be printed on, and what its silhouette says about its category.

All of it works on small images (``pixels.shrink``): areas are rectangles inside masks that were cut down to the
chest of a garment or the wall of a mug.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.columns import clip, ratio
from assetloom.operators.pixels import dilate, erode, extents, skin
from assetloom.operators.shapes import largest_rectangle
from assetloom.session import cut

#: Fixed values. Torso: the part of the garment's height, half the body's width, the largest share of the
#: torso that skin or hair may take, and the widest print. Cylinder: the band of rows, how full a column
#: of the body is (else the second), the gap that ends a body, and what the wall keeps of its width and height.
TORSO_TOP, TORSO_END, BODY_TOP, BODY_END, HALF_BODY = 0.16, 0.78, 0.35, 0.65, 0.34
MOST_SKIN, WIDEST = 0.35, 1.05
BAND_TOP, BAND_END, FULL, FAIRLY_FULL, GAP = 0.25, 0.75, 0.92, 0.7, 2
WALL_INSET, WALL_WIDTH, WALL_HEIGHT = 0.14, 0.72, 0.70
LEAST_MASK, LEAST_SIDE, LEAST_COLUMNS = 64, 8, 8


def _rectangles(px: DataFrame, mask: str) -> DataFrame:
    """(image, rx, ry, rw, rh): the largest rectangles inside a mask, as real numbers."""
    found = largest_rectangle(px, mask)
    return found.select("image", *[F.col(c).cast("double").alias(k) for c, k in (("x", "rx"), ("y", "ry"), ("width", "rw"), ("height", "rh"))])


def quad_of(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The corners (x, y) of a rectangle, from its top left one clockwise."""
    return F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))


def torso_areas(px: DataFrame, mask: str, r: int = 4, worn: int = 2) -> DataFrame:
    """(image, quad, confidence): the print area on the chest of a garment; images without one give no row.

    px: image, y, x, r, g, b and ``mask``. The chest lies between collar and hem, around the middle of the rows of the
    body. Skin and hair and ``r`` pixels around them are left out, unless they would take most of a dark garment. The
    rectangle keeps ``worn`` pixels from the mask's edge; it is made narrower where it is wider than a print.
    """
    box = extents(px, mask).where(F.col("area") >= LEAST_MASK).select("image", *[F.col(c).alias(f"g_{c}") for c in ("x0", "x1", "y0", "y1")])
    high = F.col("g_y1") - F.col("g_y0") + 1
    row = lambda share: F.floor(F.col("g_y0") + share * high)
    rows = px.where(F.col(mask) == 1).groupBy("image", "y").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).join(box, "image")
    body = rows.where((F.col("y") >= row(BODY_TOP)) & (F.col("y") < row(BODY_END)) & (F.col("n") >= 4))
    # One number a row of the image, so these medians are of few values.
    middle = body.groupBy("image").agg(F.median((F.col("a") + F.col("b")) / 2).alias("cx"), F.median(F.col("b") - F.col("a")).alias("wide"))
    prior = box.join(middle, "image", "left").withColumns({"cx": F.coalesce("cx", (F.col("g_x0") + F.col("g_x1")) / 2), "half": HALF_BODY * F.coalesce("wide", (F.col("g_x1") - F.col("g_x0") + 1).cast("double"))})
    prior = prior.select("image", row(TORSO_TOP).alias("p_y0"), row(TORSO_END).alias("p_y1"), F.floor(F.greatest(F.lit(0.0), F.col("cx") - F.col("half"))).alias("p_x0"), F.floor(F.col("cx") + F.col("half")).alias("p_x1"))
    near = dilate(px.withColumn("skin", skin(px).cast("int")), "skin", r, "near_skin").join(prior, "image")
    inside = (F.col("y") >= F.col("p_y0")) & (F.col("y") < F.col("p_y1")) & (F.col("x") >= F.col("p_x0")) & (F.col("x") < F.col("p_x1"))
    marked = cut(near.withColumn("in_prior", inside.cast("int")).withColumn("chest", F.col("in_prior") * F.col(mask)))
    shares = marked.groupBy("image").agg(F.sum("in_prior").alias("prior_area"), ratio(F.sum(F.col("chest") * F.col("near_skin")), F.sum("chest")).alias("skin_share"))
    allowed = F.when(F.col("skin_share") <= MOST_SKIN, 1 - F.col("near_skin")).otherwise(1)
    candidate = erode(marked.join(shares, "image").withColumn("chest", F.col("chest") * allowed).select("image", "y", "x", "chest"), "chest", worn, "chest")
    found = _rectangles(candidate, "chest").where((F.col("rw") >= LEAST_SIDE) & (F.col("rh") >= LEAST_SIDE)).join(shares, "image")
    width = F.least("rw", WIDEST * F.col("rh"))
    sure = clip(width * F.col("rh") / F.greatest("prior_area", F.lit(1))) * 0.6 + 0.4
    return found.select("image", quad_of(F.col("rx") + (F.col("rw") - width) / 2, F.col("ry"), width, F.col("rh")).alias("quad"), sure.alias("confidence"))


def _body_columns(px: DataFrame, mask: str, box: DataFrame) -> DataFrame:
    """(image, b_x0, b_x1): the longest stretch of columns that the mask fills over the middle rows."""
    tall = F.col("g_y1") - F.col("g_y0")
    band = px.join(box, "image").where((F.col("y") >= F.floor(F.col("g_y0") + BAND_TOP * tall)) & (F.col("y") <= F.floor(F.col("g_y0") + BAND_END * tall)))
    filled = band.groupBy("image", "x").agg(F.avg(F.col(mask).cast("double")).alias("filled"))
    full = filled.groupBy("image").agg(F.count_if(F.col("filled") > FULL).alias("n_full"), F.count_if(F.col("filled") > FAIRLY_FULL).alias("n_fair"))
    level = F.when(F.col("n_full") >= LEAST_COLUMNS, FULL).when(F.col("n_fair") >= LEAST_COLUMNS, FAIRLY_FULL)
    columns = filled.join(full.select("image", level.alias("level")), "image").where(F.col("filled") > F.col("level"))
    w = Window.partitionBy("image").orderBy("x")
    stretches = columns.withColumn("stretch", F.sum(F.coalesce((F.col("x") - F.lag("x").over(w) > GAP).cast("int"), F.lit(0))).over(w))
    each = stretches.groupBy("image", "stretch").agg(F.count("*").alias("n"), F.min("x").alias("b_x0"), F.max("x").alias("b_x1"))
    return each.groupBy("image").agg(F.max_by(F.struct("b_x0", "b_x1"), F.struct("n", -F.col("b_x0"))).alias("b")).select("image", "b.*")


def cylinder_areas(px: DataFrame, mask: str, worn: int = 2) -> DataFrame:
    """(image, quad, confidence): the print area on the wall of a mug, its handle left out; images without one give no row.

    The handle is apart from the body by the gap in its columns. A wall bends away at its sides, so the
    area is narrower and lower than the largest rectangle.
    """
    box = extents(px, mask).where(F.col("area") >= LEAST_MASK).select("image", *[F.col(c).alias(f"g_{c}") for c in ("x0", "x1", "y0", "y1")])
    spans = box.join(_body_columns(px, mask, box), "image", "left").select("image", F.coalesce("b_x0", "g_x0").alias("b_x0"), F.coalesce("b_x1", "g_x1").alias("b_x1"))
    body = px.join(spans, "image").withColumn("body", F.when(F.col("x").between(F.col("b_x0"), F.col("b_x1")), F.col(mask)).otherwise(0)).select("image", "y", "x", "body")
    body = cut(erode(body, "body", worn, "body"))
    areas = body.groupBy("image").agg(F.sum("body").alias("body_area"))
    w, h = WALL_WIDTH * F.col("rw"), WALL_HEIGHT * F.col("rh")
    found = _rectangles(body, "body").where((w >= LEAST_SIDE) & (h >= LEAST_SIDE)).join(areas, "image")
    sure = clip(w * h / F.greatest("body_area", F.lit(1))) * 0.5 + 0.45
    return found.select("image", quad_of(F.col("rx") + WALL_INSET * F.col("rw"), F.col("ry") + WALL_INSET * F.col("rh"), w, h).alias("quad"), sure.alias("confidence"))


def category_measures(px: DataFrame, mask: str, near: int = 7) -> DataFrame:
    """(image, saturation, specular, shoulder_ratio, skin_ratio) of images with mask pixels: colour of the body, the share
    of bright reflections, how much the upper third is wider than the lower half, and skin on and around it."""
    v, low = F.greatest("r", "g", "b") / 255.0, F.least("r", "g", "b") / 255.0
    on = F.col(mask) == 1
    colours = px.where(on).groupBy("image").agg(F.avg(F.when(v == 0, 0.0).otherwise((v - low) / v)).alias("saturation"), F.avg((v > 0.94).cast("double")).alias("specular"))
    rows = px.groupBy("image", "y").agg((F.max(F.when(on, F.col("x"))) - F.min(F.when(on, F.col("x"))) + 1).alias("wide"))
    box = extents(px, mask).select("image", "y0", (F.col("y1") - F.col("y0") + 1).alias("high"))
    placed = rows.join(box, "image").withColumns({"row": F.col("y") - F.col("y0"), "wide": F.coalesce("wide", F.lit(0)).cast("double")}).where("row >= 0 and row < high")
    # A width a row of the image.
    widths = placed.groupBy("image", "high").agg(F.max(F.when(F.col("row") < F.greatest(F.lit(1), F.floor(F.col("high") / 3)), F.col("wide"))).alias("upper"), F.median(F.when(F.col("row") >= F.floor(F.col("high") / 2), F.col("wide"))).alias("lower"))
    shoulders = widths.select("image", F.when(F.col("high") > 10, F.col("upper") / F.greatest("lower", F.lit(1.0))).otherwise(1.0).alias("shoulder_ratio"))
    around = dilate(px.withColumn("near", F.col(mask)), "near", near, "near").where("near = 1")
    worn = around.groupBy("image").agg(F.avg(skin(px).cast("double")).alias("skin_ratio"))
    return colours.join(shoulders, "image").join(worn, "image")


def category_scores() -> dict[str, Column]:
    """A score for each category from the columns aspect, fill, quad_fit, holes and those of ``category_measures``,
    as ``routing.category_choice`` takes them."""
    c, over = F.col, (lambda x: F.greatest(x, F.lit(0.0)))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    cut_off = lambda x: F.least(x, F.lit(1.0))
    scores = {
        "apparel": 1.2 * cut_off(over((c("shoulder_ratio") - 1.12) / 0.5)) + 1.4 * cut_off(c("skin_ratio") / 0.10) + 0.9 * over((0.80 - c("quad_fit")) / 0.5) + 0.25 * flag(c("holes") >= 1),
        "drinkware": F.when(c("holes") == 1, 1.3).when(c("holes") == 2, 0.4).otherwise(0.0) + 0.5 * flag(c("aspect").between(0.6, 1.6))
        + 0.9 * over((0.25 - c("saturation")) / 0.25) + 0.8 * cut_off(c("specular") / 0.06) + 0.4 * flag((c("quad_fit") > 0.55) & (c("quad_fit") < 0.9)),
        "wall_art": 1.6 * over((c("quad_fit") - 0.86) / 0.14) + over((c("fill") - 0.88) / 0.12) - 0.8 * flag(c("holes") > 0),
        "accessory": 0.55 + 0.7 * flag(c("aspect").between(0.35, 0.75) & (c("quad_fit") > 0.8)) + 0.5 * flag((c("aspect") > 1.7) & (c("quad_fit") > 0.9)),
    }
    return {k: F.round(over(v), 9) for k, v in scores.items()}
