"""From a raw alpha to a finished one: thin things taken off, then all steps of the refinement in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.columns import clip, contrast_curve, luminance
from assetloom.operators.edges import convolve, gaussian, squared_distances
from assetloom.operators.evaluation import percentiles
from assetloom.operators.layers import grid_means
from assetloom.operators.pixels import closing, contour_length, dilate, erode, fill_small_holes, guided_filter, lab, last_places, significant_components, suppress_shadow, trimap
from assetloom.operators.regions import label
from assetloom.session import cut

#: Least response and contrast of a strand, its least elongation, most share of the mask.
LEAST_RESPONSE, LEAST_CONTRAST, LEAST_ELONGATION, MOST_SHARE = 0.045, 0.12, 6.0, 0.08


def strand_width(long_edge: int) -> int:
    """The widest strand looked for, in pixels of an image whose long edge is given."""
    return max(3, int(0.010 * long_edge))


def _depths(px: DataFrame, mask: str, name: str) -> DataFrame:
    """(image, y, x, name): how far each pixel of the mask is from what isn't mask; very far where the mask fills the image."""
    off = px.select("image", "y", "x", (1 - F.col(mask)).alias("dp_off"))
    return squared_distances(off, "dp_off").select("image", "y", "x", F.coalesce(F.sqrt("squared"), F.lit(1e9)).alias(name))


def strands(px: DataFrame, alpha: str, strand: int, least_body: int = 2000, least_inside: int = 500) -> DataFrame:
    """(image, y, x) of the pixels of thin, dark, long things that lie across an object, such as hair.

    px: image, y, x, r, g, b (0 to 255) and ``alpha``; images are whole. ``strand`` is the width of the widest, in pixels; give
    images of unlike sizes in tables of their own (``strand_width``). What is found

    * responds to a closing of the lightness by a square of that width by over 0.55 of the image's 99th percentile, if that is
      0.045 or more, deep inside the body (alpha above 0.6), and is darker by 0.12 than the object's tone around it;
    * is thin everywhere, in every image at once: one thick place and the image has none;
    * is long: six times its width or more, 0.12 of the image's long edge, and not curled up. A length is half the outline's or the
      box's diagonal, whichever is more, so a curled thread one pixel wide counts as its box's diagonal;
    * lies where the object is thick, eight times the strand's radius or more;
    * takes up 8 % of the body at the most, all of it together, or nothing is found.

    Images with fewer than ``least_body`` pixels of body or ``least_inside`` deep inside have none.
    """
    wide = strand | 1
    sides = last_places(px).select("image", (F.greatest("h", "w") + 1).cast("double").alias("st_long"), ((F.col("h") + 1) * (F.col("w") + 1)).alias("st_all"))
    df = lab(px).select("image", "y", "x", luminance(F.col("L")).alias("st_l"), (F.col(alpha) > 0.6).cast("int").alias("st_body")).join(sides, "image")
    df = erode(closing(cut(df), "st_l", wide // 2, "st_closed"), "st_body", (3 * wide | 1) // 2, "st_in")
    tone = grid_means(df, {"st_tone": F.col("st_l")}, F.col("st_body").cast("double"), F.greatest(F.lit(6.0), 0.05 * F.col("st_long")))
    df = cut(tone.withColumns({"st_hat": F.col("st_closed") - F.col("st_l"), "st_dark": F.col("st_tone") - F.col("st_l")}))
    size = df.groupBy("image").agg(F.sum("st_body").alias("st_bodies"), F.sum("st_in").alias("st_ins"))
    top = percentiles(df.where("st_in = 1"), "st_hat", ["image"], {"st_top": 0.99})
    fit = size.join(top, "image").where((F.col("st_bodies") >= least_body) & (F.col("st_ins") >= least_inside) & (F.col("st_top") >= LEAST_RESPONSE))
    df = df.join(fit, "image")
    hit = (F.col("st_hat") > F.greatest(F.lit(LEAST_RESPONSE), 0.55 * F.col("st_top"))) & (F.col("st_in") == 1) & (F.col("st_dark") > LEAST_CONTRAST)
    found = cut(closing(df.withColumn("st_hit", hit.cast("int")), "st_hit", 1, "st_on"))
    found = cut(found.join(_depths(found, "st_on", "st_deep"), ["image", "y", "x"]))
    thin = found.groupBy("image").agg(F.sum("st_on").alias("n"), F.max("st_deep").alias("deepest"), F.first("st_all").alias("all"))
    thin = thin.where((F.col("n") >= 0.0004 * F.col("all")) & (F.col("deepest") <= 1.6 * strand)).select("image")
    found = cut(found.join(thin, "image", "left_semi"))
    pieces = cut(label(found, "st_on"))
    at = pieces.join(found.select("image", "y", "x", "st_deep"), ["image", "y", "x"]).join(_depths(found, "st_body", "st_thick"), ["image", "y", "x"])
    height, width = F.max("y") - F.min("y") + 1, F.max("x") - F.min("x") + 1
    shape = at.groupBy("image", "component").agg(F.count("*").alias("area"), F.max("st_deep").alias("radius"), F.hypot(height, width).alias("extent"))
    # Components are numbered over all images, so each is an image of its own here.
    around = contour_length(pieces.select(F.col("component").alias("image"), "y", "x")).select(F.col("image").alias("component"), "contour")
    middle = percentiles(at, "st_thick", ["component"], {"thick": 0.5})
    shape = shape.join(around, "component").join(middle, "component").join(sides, "image")
    length, least = F.greatest(F.col("contour") / 2, F.col("extent")), 0.12 * F.col("st_long")
    long = (length / F.greatest(F.lit(1.0), 2 * F.col("radius")) >= LEAST_ELONGATION) & (length >= least) & (F.col("extent") >= 0.8 * least)
    lies = F.col("thick") >= F.greatest(F.lit(12.0), 8 * F.greatest(F.lit(1.0), F.col("radius")))
    kept = cut(shape.where((F.col("area") >= 12) & long & lies).select("image", "component", "area"))
    share = kept.groupBy("image").agg(F.sum("area").alias("area")).join(size, "image").where(F.col("area") <= MOST_SHARE * F.col("st_bodies"))
    return pieces.join(kept.join(share, "image", "left_semi"), ["image", "component"], "left_semi").select("image", "y", "x")


def remove_strands(px: DataFrame, alpha: str, strand: int, strength: float = 1.0, **limits: int) -> DataFrame:
    """Takes ``strands`` and a soft seam around them off ``alpha``; adds strands_removed, whether the image had any."""
    df = cut(px)
    found = cut(strands(df, alpha, strand, **limits))
    marked = df.join(found.withColumn("rs_on", F.lit(1)), ["image", "y", "x"], "left").na.fill(0, ["rs_on"])
    soft = convolve(dilate(marked, "rs_on", 1, "rs_wide"), "rs_wide", gaussian(1.0), "rs_soft")
    had = found.select("image").distinct().withColumn("strands_removed", F.lit(True))
    out = soft.join(had, "image", "left").withColumn("strands_removed", F.coalesce("strands_removed", F.lit(False)))
    return out.withColumn(alpha, F.col(alpha) * (1 - clip(F.col("rs_soft") * strength))).select(*px.columns, "strands_removed")


def refine(px: DataFrame, alpha: str, expects_holes: Column, soft_edges: Column, has_strands: bool = False, strand: int = 3, band: int = 9, radius: int = 8, eps: float = 1e-4, least_unknown: int = 32) -> DataFrame:
    """The finished ``alpha`` of each pixel, by the steps in their order.

    1. Small pieces go, with a pixel around them; small holes are filled: below 0.004 of the image where holes belong to the
       object (``expects_holes``, a column that is one for an image), else 0.05.
    2. Cast shadows, then (``has_strands``) thin things across the object are taken off.
    3. Where it is neither surely object nor surely backdrop, ``alpha`` follows the picture's edges (guided filter); only in images
       with more than ``least_unknown`` such pixels.
    4. The curve of the category (``soft_edges``) steepens the edge; traces become 0 and near-solid pixels 1.

    px: image, y, x, r, g, b (0 to 255), ``alpha`` and what the two columns read; images without a pixel above 0.5 stay
    as they are. ``band`` and ``radius`` are pixels: give images of unlike sizes in tables of their own.
    """
    own = [c for c in px.columns if c != alpha]
    df = cut(px.withColumns({alpha: clip(F.col(alpha).cast("double")), "rf_on": (F.col(alpha) > 0.5).cast("int"), "rf_holes": F.coalesce(expects_holes, F.lit(False)), "rf_soft": F.coalesce(soft_edges, F.lit(False))}))
    kept = significant_components(label(df, "rf_on")).select("image", "y", "x", F.lit(1).alias("rf_big"))
    df = cut(df.join(kept, ["image", "y", "x"], "left").na.fill(0, ["rf_big"]))
    filled = [fill_small_holes(df.where(which), "rf_big", limit) for which, limit in ((F.col("rf_holes"), 0.004), (~F.col("rf_holes"), 0.05))]
    df = cut(filled[0].unionByName(filled[1]))
    any_on = df.groupBy("image").agg((F.sum("rf_on") > 0).alias("rf_any"))
    lost = df.withColumn("rf_lost", ((F.col("rf_on") == 1) & (F.col("filled") == 0)).cast("int"))
    df = dilate(lost, "rf_lost", 1, "rf_near").join(any_on, "image").withColumn("rf_raw", F.col(alpha))
    df = df.withColumn(alpha, F.when((F.col("rf_on") == 0) & (F.col("filled") == 1), 1.0).when(F.col("rf_near") == 1, 0.0).otherwise(F.col(alpha)))
    df = suppress_shadow(cut(df), alpha)
    df = remove_strands(df, alpha, strand) if has_strands else df.withColumn("strands_removed", F.lit(False))
    df = trimap(df, alpha, (max(3, band) | 1) // 2).withColumn("rf_guide", (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) / 255.0)
    df = cut(guided_filter(df, "rf_guide", alpha, max(2, radius), eps, "rf_guided"))
    enough = df.groupBy("image").agg((F.count_if(F.col("trimap") == 128) > least_unknown).alias("rf_enough"))
    guided = F.when(F.col("rf_enough") & (F.col("trimap") == 128), clip(F.col("rf_guided"))).otherwise(F.col(alpha))
    final = F.when(F.col("rf_any"), contrast_curve(guided, F.col("rf_soft"))).otherwise(F.col("rf_raw"))
    return df.join(enough, "image").select(*own, final.alias(alpha), (F.col("rf_any") & F.col("shadow_suppressed")).alias("shadow_suppressed"), "strands_removed", (F.col("rf_any") & F.col("rf_enough")).alias("guided"))
