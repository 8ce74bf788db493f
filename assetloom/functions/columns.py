"""Column functions: text, names, scores. Everything here stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetloom.schema import CATEGORIES, CATEGORY_ALIASES, COLOUR_ALIASES


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def ramp(x: Column, start: float, width: float) -> Column:
    """0 up to ``start``, then linear to 1 over ``width``."""
    return clip((x - F.lit(float(start))) / F.lit(float(width)))


def rounded(x: Column, digits: int) -> Column:
    """Half up at ``digits``, once what sums of doubles leave beyond nine digits is gone, so that ties don't hang on it."""
    return F.round(F.round(x, 9), digits)


def falling(x: Column, start: float, width: float) -> Column:
    return clip(1.0 - (x - F.lit(float(start))) / F.lit(float(width)))


def band_score(x: Column, lo: Column, hi: Column, softness: float) -> Column:
    """1 within [lo, hi], falling linearly to 0 over ``softness`` beyond."""
    gap = F.when(x < lo, lo - x).when(x > hi, x - hi).otherwise(0.0)
    return clip(1.0 - gap / F.lit(float(softness)))


def coverage_score(x: Column, lo: Column, hi: Column) -> Column:
    """1 within the band; below it the share of ``lo``, above it the share of the room left."""
    return F.when(x.between(lo, hi), 1.0).when(x < lo, clip(x / F.greatest(lo, F.lit(1e-6)))).otherwise(clip((1 - x) / F.greatest(1 - hi, F.lit(1e-6))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def blank_to_null(x: Column) -> Column:
    trimmed = F.trim(x)
    return F.when(trimmed != "", trimmed)


def key_of(name: Column) -> Column:
    """Column names as people write them, made comparable."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[ -]", "_"), "^﻿+", "")


def category(raw: Column) -> Column:
    """A category of the taxonomy from free text; unknown or missing gives auto."""
    key = F.regexp_replace(F.lower(F.trim(raw)), "[ -]", "_")
    out = F.when(key.isin(CATEGORIES), key)
    for name, others in CATEGORY_ALIASES.items():
        out = out.when(key.isin(others), name)
    return F.coalesce(out, F.lit("auto"))


def colour(raw: Column) -> Column:
    name = F.replace(F.lower(raw), F.lit("_"), F.lit("-"))
    plain, out = F.replace(name, F.lit("-"), F.lit("")), None
    for alias, canonical in COLOUR_ALIASES.items():
        out = (F if out is None else out).when(plain == alias, canonical)
    return out.otherwise(name)


def is_http(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike("^https?://"), F.lit(False))


def basename(x: Column) -> Column:
    return F.regexp_extract(x, "[^/]*$", 0)


def slug(index: Column, source: Column, sku: Column | None = None) -> Column:
    """``007_name``: the last part of the sku or source, without suffix, in safe characters, 48 at most."""
    name = source if sku is None else F.coalesce(F.when(sku != "", sku), source)
    stem = F.regexp_replace(basename(name), r"\.[a-zA-Z0-9]{2,5}$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    stem = F.when(stem == "", "image").otherwise(stem)
    return F.concat(F.format_string("%03d", index), F.lit("_"), F.substring(stem, 1, 48))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def html_escape(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def safe_filename(x: Column) -> Column:
    return F.substring(F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "_"), 1, 56)


def base64_line(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def data_uri(mime: str, data: Column) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), base64_line(data))


def decode_data_uri(x: Column) -> Column:
    return F.unbase64(F.regexp_replace(x, "^[^,]*,", ""))


def relative_url(x: Column) -> Column:
    """File name of an artifact address; data addresses and null pass."""
    return F.when(x.startswith("data:"), x).otherwise(basename(x))


def artifact_url(job: Column, name: Column) -> Column:
    return F.concat(F.lit("/artifacts/"), job, F.lit("/"), name)


def with_suffix(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))


def percent(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", 100.0 * x)


def is_safe_id(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[A-Za-z0-9._-]+\z"), F.lit(False))


def stays_inside(path: Column) -> Column:
    """Whether a relative path can't leave its folder: no step up that isn't taken back, and not absolute."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda acc, part: F.struct(
        (acc["now"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("now"),
        F.least(acc["least"], acc["now"] + F.when(part == "..", -1).otherwise(0)).alias("least"),
    ), lambda acc: acc["least"])
    return F.coalesce((depth >= 0) & ~path.startswith("/"), F.lit(False))


def ordered_quad(quad: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left (y grows downwards).

    They are sorted by their angle around the middle and turned so that the least x + y leads.
    """
    mean = lambda i: F.aggregate(quad, F.lit(0.0), lambda acc, p: acc + p[i]) / 4
    around = F.array_sort(F.transform(quad, lambda p, i: F.struct(F.atan2(p[1] - mean(1), p[0] - mean(0)).alias("angle"), i.alias("i"), p.alias("p"))))
    points = F.transform(around, lambda s: s["p"])
    first = F.array_min(F.transform(points, lambda p, i: F.struct((p[0] + p[1]).alias("sum"), i.alias("i"))))["i"]
    return F.concat(F.slice(points, first + 1, F.lit(4)), F.slice(points, F.lit(1), first))


def luminance(lightness: Column) -> Column:
    """Lab lightness (0-100) as 0 to 1."""
    return lightness / 100.0


def is_truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "on")


def to_uint8(alpha: Column) -> Column:
    """An alpha in [0, 1] as 0 to 255, halves up."""
    return F.floor(clip(alpha * 255 + 0.5, 0, 255)).cast("int")


def contrast_curve(alpha: Column, soft: Column) -> Column:
    """Steepens the transition, then drops traces and fills near-solid pixels."""
    steep = clip((alpha - 0.5) * F.when(soft, 1.35).otherwise(2.2) + 0.5)
    return F.when(steep < 0.02, 0.0).when(steep > 0.985, 1.0).otherwise(steep)


def homography(quad: Column) -> Column:
    """3x3 matrix that maps the unit square's corners (TL, TR, BR, BL) to ``quad``, row by row."""
    x = [quad[i][0] for i in range(4)]
    y = [quad[i][1] for i in range(4)]
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    det = dx1 * dy2 - dx2 * dy1
    g, h = ratio(sx * dy2 - dx2 * sy, det), ratio(dx1 * sy - sx * dy1, det)
    return F.array(
        F.array(x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0]),
        F.array(y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0]),
        F.array(g, h, F.lit(1.0)),
    )
