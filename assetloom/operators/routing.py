"""Quality terms to confidence, reasons, vetoes and verdict, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.columns import band_score, clip, coverage_score, falling, ramp
from assetloom.schema import CATEGORIES, FAILED, READY, REVIEW, WEIGHTS, Settings, taxonomy

EMPTY_BELOW, FULL_ABOVE = 0.004, 0.985


def weighted_mean(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the terms that are not null, their weights scaled up to one; null if all are null."""
    total = sum((F.when(t.isNotNull(), F.lit(weights[k]) * t).otherwise(0.0) for k, t in terms.items()), F.lit(0.0))
    weight = sum((F.when(t.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, t in terms.items()), F.lit(0.0))
    return F.try_divide(total, weight)


def ensemble_term(iou: Column, boundary_f1: Column) -> Column:
    """Agreement with a second mask; null without one."""
    return clip(F.when(iou.isNotNull(), 0.72 * iou + 0.28 * boundary_f1))


def border_score(contact: Column) -> Column:
    return falling(contact, 0.02, 0.28)


def sharpness_score(uncertain: Column, perimeter: Column) -> Column:
    """From the uncertain pixels for each pixel of outline; short outlines score 0."""
    return F.when(perimeter < 32, 0.0).otherwise(falling(uncertain / F.greatest(perimeter, F.lit(1)), 2, 12))


def complexity_score(perimeter: Column, area: Column) -> Column:
    return F.when(area < 32, 0.0).otherwise(ramp(perimeter / F.sqrt(F.greatest(area, F.lit(1))), 4.2, 8))


def component_penalty(pieces: Column, size_ratio: Column, worst_solidity: Column) -> tuple[Column, Column]:
    """(penalty, whether the pieces are several products): two to four solid pieces of like size are no defect."""
    several = pieces.between(2, 4) & (size_ratio >= 0.25) & (worst_solidity >= 0.5)
    return F.when(several, 0.0).otherwise(clip((pieces - 1) / 4.0)), several


def hole_penalty(holes: Column, expected: Column) -> Column:
    return F.when(holes > 12, ramp(holes, 12, 30)).when((holes > 0) & ~expected, 0.35).otherwise(0.0)


def topology_score(pieces_penalty: Column, holes_penalty: Column, solidity: Column) -> Column:
    return clip(1 - 0.5 * pieces_penalty - 0.3 * holes_penalty - 0.4 * clip((0.62 - solidity) / 0.4))


def shape_score(fill: Column, aspect: Column, solidity: Column, quad_fit: Column, t: str = "") -> Column:
    """Silhouette against the category's bands; needs the taxonomy's columns beside it."""
    col = lambda name: F.col(t + name)
    by_fill = F.when(solidity >= 0.93, 1.0).otherwise(band_score(fill, col("fill_lo"), col("fill_hi"), 0.30))
    by_aspect = band_score(aspect, col("aspect_lo"), col("aspect_hi"), 1.20)
    by_quad = F.when(col("quad_fit_min").isNull(), 1.0).otherwise(clip(1 - (col("quad_fit_min") - quad_fit) / 0.25))
    return clip(F.least(by_fill, by_aspect, by_quad))


def with_taxonomy(df: DataFrame) -> DataFrame:
    """Adds the category's row; unknown categories get that of auto. The dimension has five rows."""
    known = F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("auto")
    dimension = F.broadcast(taxonomy(df.sparkSession).withColumnRenamed("category", "known_category"))
    return df.withColumn("known_category", known).join(dimension, "known_category").drop("known_category")


def route(confidence: Column, veto: Column, settings: Settings) -> Column:
    return F.when((confidence >= settings.ready_threshold) & ~veto, READY).when(confidence >= settings.review_threshold, REVIEW).otherwise(FAILED)


def assess(signals: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Scores one row a mask and routes it.

    Needs category, coverage, the terms of WEIGHTS other than coverage and ensemble, iou and
    boundary_f1 against a second mask (null without one), component_penalty, multi_instance,
    hole_penalty, border_contact, complexity and shadow_suppressed. Adds terms, confidence, reasons
    (codes in a fixed order), veto and verdict. Masks that are almost empty or full fail at once.
    """
    settings = settings or Settings.of(signals.sparkSession)
    df = with_taxonomy(signals)
    agree = ensemble_term(F.col("iou"), F.col("boundary_f1"))
    cover = coverage_score(F.col("coverage"), F.col("coverage_lo"), F.col("coverage_hi"))
    terms = {k: F.col(k) for k in WEIGHTS if k not in ("coverage", "ensemble")} | {"ensemble": agree, "coverage": cover}
    empty, full = F.col("coverage") < EMPTY_BELOW, F.col("coverage") > FULL_ABOVE
    # Without the noise of sums, so that neither thresholds nor ties hang on it.
    confidence = F.round(clip(weighted_mean(terms, WEIGHTS) * (1 - 0.10 * F.col("complexity"))), 9)
    split = F.col("component_penalty") > 0.2
    rules = [
        ("outline_off_edges", F.col("edge_alignment") < 0.45),
        ("soft_edge", F.col("sharpness") < 0.55),
        ("second_model_disagrees", F.coalesce(agree < 0.78, F.lit(False))),
        ("split_into_pieces", split),
        ("several_products", ~split & F.col("multi_instance")),
        ("unexpected_holes", F.col("hole_penalty") > 0.2),
        ("cuts_through_object", F.col("boundary_contrast") < 0.5),
        ("part_of_larger_object", F.col("bg_consistency") < 0.55),
        ("atypical_silhouette", F.col("shape_prior") < 0.6),
        ("unexpected_coverage", cover < 0.7),
        ("cropped_by_frame", F.col("border_contact") > 0.06),
        ("complex_outline", F.col("complexity") > 0.4),
        ("shadow_removed", F.col("shadow_suppressed")),
    ]
    vetoing = ["second_model_disagrees", "split_into_pieces", "cuts_through_object", "part_of_larger_object", "atypical_silhouette", "cropped_by_frame"]
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())
    veto = reduce(lambda a, b: a | b, (F.coalesce(rule, F.lit(False)) for name, rule in rules if name in vetoing))
    df = df.withColumns({"terms": F.map_filter(F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()), "raw": confidence, "found": found, "veto": veto})
    verdict = F.when(empty | full, FAILED).otherwise(route(F.col("raw"), F.col("veto"), settings))
    reasons = (
        F.when(empty, F.array(F.lit("no_product")))
        .when(full, F.array(F.lit("covers_whole_frame")))
        .when(verdict == FAILED, F.concat(F.array(F.lit("below_floor")), F.col("found")))
        .when((verdict == READY) & (F.size("found") == 0), F.array(F.lit("clean")))
        .otherwise(F.col("found"))
    )
    return df.withColumns({"verdict": verdict, "reasons": reasons, "confidence": F.round(F.when(empty | full, 0.0).otherwise(F.col("raw")), 4)}).drop("raw", "found")


def category_choice(scores: Column, order: list[str]) -> tuple[Column, Column]:
    """(best category, margin to the next) of a map of scores; ties go to the first of ``order``."""
    ranked = F.array_sort(F.array(*[F.struct((-scores[k]).alias("score"), F.lit(i).alias("place"), F.lit(k).alias("name")) for i, k in enumerate(order)]))
    return ranked[0]["name"], ranked[1]["score"] - ranked[0]["score"]


def fuse(geometric: Column, zero_shot: Column) -> Column:
    """Geometric and zero-shot scores in one; without the latter the former stand alone."""
    return F.coalesce(0.6 * zero_shot + 0.4 * geometric, geometric)


def choice_confidence(best: Column, total: Column, margin: Column) -> Column:
    return 0.5 * F.coalesce(F.try_divide(best, total), F.lit(0.0)) + 0.5 * F.least(F.lit(1.0), margin / 0.25)
