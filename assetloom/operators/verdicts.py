"""From images and masks to one verdict a row: measuring, scoring and routing in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions.columns import category
from assetloom.operators import pixels, routing
from assetloom.schema import FAILED, Settings
from assetloom.session import cut

#: Fewest mask pixels that have a silhouette.
LEAST_PIXELS = 64


def measure(px: DataFrame, mask: str, alpha: str) -> DataFrame:
    """One row an image, everything that a mask alone tells: coverage, contact, uncertain, perimeter and ``pixels.topology``."""
    out = pixels.topology(px, mask)
    for part in (pixels.coverage(px, mask), pixels.border_contact(px, mask), pixels.edge_width(px, alpha, mask)):
        out = out.join(part, "image", "left")
    return out


def signals(measured: DataFrame, least: int = LEAST_PIXELS) -> DataFrame:
    """Adds the terms and penalties that ``routing.assess`` takes from measures and category.

    solidity and quad_fit, iou and boundary_f1, and the terms from colours may stand beside the
    measures; what isn't there counts as unknown and takes no part.
    """
    optional = ("solidity", "worst_solidity", "quad_fit", "iou", "boundary_f1", "edge_alignment", "bg_consistency", "boundary_contrast")
    df = measured.withColumns({c: F.lit(None).cast("double") for c in optional if c not in measured.columns})
    if "shadow_suppressed" not in df.columns:
        df = df.withColumn("shadow_suppressed", F.lit(False))
    own = df.columns
    df = routing.with_taxonomy(df)
    penalty, several = routing.component_penalty(F.col("pieces"), F.coalesce("size_ratio", F.lit(1.0)), F.coalesce("worst_solidity", F.lit(1.0)))
    df = df.withColumns({"component_penalty": F.when(F.col("pieces") == 0, 1.0).otherwise(penalty), "multi_instance": several, "hole_penalty": routing.hole_penalty(F.col("holes"), F.col("expect_holes"))})
    whole = routing.topology_score(F.col("component_penalty"), F.col("hole_penalty"), F.coalesce("solidity", F.lit(1.0)))
    shape = routing.shape_score(F.col("fill"), F.col("aspect"), F.coalesce("solidity", F.lit(0.0)), F.col("quad_fit"))
    terms = {
        "topology": F.when(F.col("pieces") == 0, 0.0).otherwise(whole),
        "shape_prior": F.when(F.col("main_area") < least, 0.0).otherwise(shape),
        "border_contact": F.col("contact"),
        "sharpness": routing.sharpness_score(F.col("uncertain"), F.col("perimeter")),
        "complexity": F.coalesce(routing.complexity_score(F.col("contour"), F.col("main_area")), F.lit(0.0)),
    }
    return df.withColumns(terms).select(*[c for c in own if c not in terms], *terms, "component_penalty", "multi_instance", "hole_penalty")


def assess_images(decoded: DataFrame, masks: DataFrame, hints: DataFrame, settings: Settings | None = None, radius: int = 3) -> DataFrame:
    """(image, status, category, verdict, confidence, reasons, error): one row for each decoded image.

    decoded: rows of ``sources.images.decode``; masks: (image, y, x, alpha); hints: (image, category).
    Images that can't be read, break a limit or have no mask keep their row, in error and failed; the
    others aren't touched by them. Images without a hint are of the category auto.
    """
    name = F.col("image.origin")
    listed = decoded.select(name.alias("image"), "error")
    fine = decoded.where("error is null")
    turned = [F.col("orientation")] if "orientation" in decoded.columns else []
    px = pixels.from_images(fine.select("image", *turned)).join(masks, ["image", "y", "x"])
    # Every measure starts from here, so images are decoded and joined once.
    px = cut(pixels.suppress_shadow(px, "alpha").withColumn("m", (F.col("alpha") > 0.5).cast("int")))
    grey = px.withColumn("grey", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    out = measure(px, "m", "alpha")
    shadow = px.groupBy("image").agg(F.max("shadow_suppressed").alias("shadow_suppressed"))
    for part in (pixels.edge_alignment(grey, "grey", "m", radius), pixels.background_consistency(px, "m", 2 * radius, 2 * radius), pixels.boundary_contrast(px, "m", radius), shadow):
        out = out.join(part, "image", "left")
    one = hints.groupBy("image").agg(F.max("category").alias("hint"))
    out = out.join(one, "image", "left").withColumn("category", category(F.col("hint"))).drop("hint")
    found = routing.assess(signals(out), settings).select("image", "category", "verdict", "confidence", "reasons")
    rows = listed.join(found, "image", "left").withColumn("error", F.coalesce("error", F.when(F.col("verdict").isNull(), "no mask")))
    bad = F.col("error").isNotNull()
    return rows.select(
        "image", F.when(bad, "error").otherwise("ok").alias("status"), "category", F.when(bad, FAILED).otherwise(F.col("verdict")).alias("verdict"),
        F.when(~bad, F.col("confidence")).alias("confidence"), F.when(bad, F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"), "error",
    )
