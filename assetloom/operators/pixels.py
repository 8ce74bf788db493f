"""Array operators over a table of pixels: image, y, x and values.

An image is rows, so filters are window frames, neighbourhoods are joins, and regions are connected
components of a table of links. Images are partitioned by their id; an image's rows and columns are
windows of their own, so no task needs a whole image at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.columns import band_score, clip, falling, ratio
from assetloom.operators.edges import convolve, gaussian, slopes
from assetloom.operators.evaluation import percentiles
from assetloom.operators.regions import filled_runs, hole_runs, label, labelled_runs, pixels_of, run_areas
from assetloom.operators.shapes import largest_rectangle, quad_fit, solidity
from assetloom.operators.windows import AXES, extremes, means
from assetloom.session import cut


#: The grey that transparent pixels are laid on.
BACKDROP = 128


def from_vectors(rows: DataFrame, image: str, values: str, width: int) -> DataFrame:
    """(image, y, x, e) from arrays that hold a grid row by row."""
    at = rows.select(F.col(image).alias("image"), F.posexplode(values).alias("p", "v"))
    return at.select("image", F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).alias("x"), F.col("v").cast("double").alias("e"))


def from_images(images: DataFrame) -> DataFrame:
    """(image, y, x, r, g, b) from rows of Spark's image source; unreadable images, and those with channels of another
    number than 1, 3 or 4, give no rows.

    Grey is repeated, alpha is laid on BACKDROP, and images with an ``orientation`` (1 to 8) beside them are
    turned upright. An image is cut into its lines first, and each line into its pixels, so no row lists all pixels.
    """
    turned = F.col("orientation") if "orientation" in images.columns else F.lit(1)
    good = images.select("image.*", F.coalesce(turned, F.lit(1)).alias("turned")).where("height > 0 and nChannels in (1, 3, 4)")
    size = ["width", "height", "nChannels", "turned"]
    lines = good.select(F.col("origin").alias("image"), *size, "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    # One character a byte, so that a character's code is the byte's value.
    length = F.col("nChannels") * F.col("width")
    lines = lines.select("image", *size, "y", F.decode(F.substring("data", F.col("y") * length + 1, length), "ISO-8859-1").alias("line"))
    at = lines.select("image", *size, "y", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    byte = lambda k: F.ascii(F.substring("line", F.col("nChannels") * F.col("x") + k, F.lit(1)))
    laid = lambda k: F.round((byte(k) * byte(4) + BACKDROP * (255 - byte(4))) / 255).cast("int")
    colour = lambda k: F.when(F.col("nChannels") == 1, byte(1)).when(F.col("nChannels") == 3, byte(k)).otherwise(laid(k))
    y, x, down, right = F.col("y"), F.col("x"), F.col("height") - 1 - F.col("y"), F.col("width") - 1 - F.col("x")
    # Where each orientation has the stored pixel; 5 to 8 swap the sides.
    places = {1: (y, x), 2: (y, right), 3: (down, right), 4: (down, x), 5: (x, y), 6: (x, down), 7: (right, down), 8: (right, y)}
    place = lambda axis: F.coalesce(*[F.when(F.col("turned") == k, p[axis]) for k, p in places.items()])
    return at.select("image", place(0).alias("y"), place(1).alias("x"), colour(3).alias("r"), colour(2).alias("g"), colour(1).alias("b"))


def box(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """A square neighbourhood's mean; pixels outside the image don't count."""
    return means(px, {out: F.col(value)}, radius)


def erode(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    return extremes(px, {out: (value, F.min)}, radius)


def dilate(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    return extremes(px, {out: (value, F.max)}, radius)


def closing(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Dilation, then erosion: fills what is narrower than the square."""
    return erode(dilate(px, value, radius, out), out, radius, out)


def opening(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Erosion, then dilation: takes off what is narrower than the square."""
    return dilate(erode(px, value, radius, out), out, radius, out)


def trimap(px: DataFrame, alpha: str, radius: int) -> DataFrame:
    """Adds trimap: 255 deep inside, 0 deep outside, 128 between."""
    marked = px.withColumn("fg", (F.col(alpha) > 0.92).cast("int")).withColumn("bg", (F.col(alpha) < 0.08).cast("int"))
    worn = extremes(marked, {"fg_in": ("fg", F.min), "bg_in": ("bg", F.min)}, radius)
    return worn.withColumn("trimap", F.when(F.col("fg_in") == 1, 255).when(F.col("bg_in") == 1, 0).otherwise(128)).drop("fg", "bg", "fg_in", "bg_in")


def boundary_band(px: DataFrame, mask: str, width: int) -> DataFrame:
    """Adds band: whether the pixel lies near the mask's outline, in a square of odd side >= max(3, width)."""
    radius = (max(3, width) | 1) // 2
    near = extremes(px, {"most": (mask, F.max), "least": (mask, F.min)}, radius)
    return near.withColumn("band", F.col("most") > F.col("least")).drop("most", "least")


def guided_filter(px: DataFrame, guide: str, value: str, radius: int, eps: float, out: str) -> DataFrame:
    """Edge-preserving smoothing of ``value`` along ``guide``: local linear fits, then their mean."""
    g, v = F.col(guide).cast("double"), F.col(value).cast("double")
    df = px.withColumns({"gf_g": g, "gf_v": v})
    df = means(df, {"gf_g_m": g, "gf_v_m": v, "gf_gg_m": g * g, "gf_gv_m": g * v}, radius)
    a = (F.col("gf_gv_m") - F.col("gf_g_m") * F.col("gf_v_m")) / (F.col("gf_gg_m") - F.col("gf_g_m") * F.col("gf_g_m") + eps)
    df = df.withColumn("gf_a", a).withColumn("gf_b", F.col("gf_v_m") - F.col("gf_a") * F.col("gf_g_m"))
    df = means(df, {"gf_a_m": F.col("gf_a"), "gf_b_m": F.col("gf_b")}, radius)
    return df.withColumn(out, F.col("gf_a_m") * F.col("gf_g") + F.col("gf_b_m")).select(*px.columns, out)


def mask_overlap(a: DataFrame, b: DataFrame, keys=("image", "y", "x")) -> DataFrame:
    """iou (1 for two empty masks), dice, mae and sad_k of two mattes (column alpha) by image."""
    both = a.select(*keys, F.col("alpha").alias("p")).join(b.select(*keys, F.col("alpha").alias("g")), list(keys))
    pb, gb, diff = F.col("p") > 0.5, F.col("g") > 0.5, F.abs(F.col("p") - F.col("g"))
    inter, union = F.count_if(pb & gb), F.count_if(pb | gb)
    return both.groupBy("image").agg(
        F.when(union == 0, 1.0).otherwise(ratio(inter, union)).alias("iou"),
        ratio(2 * inter, F.greatest(F.lit(1), F.count_if(pb) + F.count_if(gb))).alias("dice"),
        F.avg(diff).alias("mae"), (F.sum(diff) / 1000.0).alias("sad_k"),
    )


def outline(px: DataFrame, mask: str) -> DataFrame:
    """Adds edge: mask pixels with a pixel of the background beside them (the frame doesn't count)."""
    df = px
    for i, (line, along) in enumerate(AXES):
        w = Window.partitionBy("image", line).orderBy(along)
        beside = F.least(F.coalesce(F.lag(mask).over(w), F.col(mask)), F.coalesce(F.lead(mask).over(w), F.col(mask)))
        df = df.withColumn(f"edge_{i}", beside)
    return df.withColumn("edge", ((F.col(mask) == 1) & (F.least("edge_0", "edge_1") == 0)).cast("int")).drop("edge_0", "edge_1")


def boundary_f1(px: DataFrame, a: str, b: str, tolerance: int) -> DataFrame:
    """f1 of two masks' outlines by image: matched if the other outline passes within a square of ``tolerance``."""
    ea = outline(px, a).withColumnRenamed("edge", "ea")
    both = outline(ea, b).withColumnRenamed("edge", "eb")
    near = extremes(both, {"na": ("ea", F.max), "nb": ("eb", F.max)}, tolerance)
    sums = near.groupBy("image").agg(F.sum("ea").alias("a"), F.sum("eb").alias("b"), F.sum(F.col("ea") * F.col("nb")).alias("pa"), F.sum(F.col("eb") * F.col("na")).alias("pb"))
    p, r = ratio(F.col("pa"), F.col("a")), ratio(F.col("pb"), F.col("b"))
    f1 = F.when((F.col("a") == 0) & (F.col("b") == 0), 1.0).when((F.col("a") == 0) | (F.col("b") == 0), 0.0).otherwise(ratio(2 * p * r, p + r))
    return sums.select("image", f1.alias("boundary_f1"))


def coverage(px: DataFrame, mask: str) -> DataFrame:
    return px.groupBy("image").agg(F.avg(F.col(mask).cast("double")).alias("coverage"))


def last_places(px: DataFrame) -> DataFrame:
    """(image, h, w): the last row and column of each image."""
    return px.groupBy("image").agg(F.max("y").alias("h"), F.max("x").alias("w"))


def border_contact(px: DataFrame, mask: str) -> DataFrame:
    """Mean of the mask over the frame's four lines; corners count in both of theirs."""
    lines = sum(((c == v).cast("int") for c, v in ((F.col("y"), F.lit(0)), (F.col("y"), F.col("h")), (F.col("x"), F.lit(0)), (F.col("x"), F.col("w")))), F.lit(0))
    return px.join(last_places(px), "image").withColumn("lines", lines).groupBy("image").agg((F.sum(F.col(mask) * F.col("lines")) / F.sum("lines")).alias("contact")).withColumn("border", falling(F.col("contact"), 0.02, 0.28))


def extents(px: DataFrame, mask: str) -> DataFrame:
    """Bounding box, fill and aspect of each image's mask; images without mask pixels give no row."""
    on = px.where(F.col(mask) == 1).groupBy("image").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("area"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return on.withColumn("fill", F.col("area") / (w * h)).withColumn("aspect", w / h)


def shape_bands(shapes: DataFrame, fill: tuple[float, float], aspect: tuple[float, float]) -> DataFrame:
    lit = F.lit
    return shapes.withColumn("shape", F.least(band_score(F.col("fill"), lit(fill[0]), lit(fill[1]), 0.30), band_score(F.col("aspect"), lit(aspect[0]), lit(aspect[1]), 1.20)))


def component_areas(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image", "component").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))


def significant_components(labelled: DataFrame, share: float = 0.04, least: int = 24) -> DataFrame:
    """The pixels of components of at least max(least, share of the image's largest)."""
    areas = component_areas(labelled)
    top = areas.groupBy("image").agg(F.max("area").alias("top"))
    kept = areas.join(top, "image").where(F.col("area") >= F.greatest(F.lit(float(least)), share * F.col("top"))).select("image", "component")
    return labelled.join(kept, ["image", "component"], "left_semi")


def holes(px: DataFrame, mask: str) -> DataFrame:
    """(image, component, area) of the background components that don't touch the frame."""
    size = px.groupBy("image").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    areas = component_areas(label(px, mask, value=0, diagonal=False)).join(size, "image")
    return areas.where("y0 > 0 and x0 > 0 and y1 < h and x1 < w").select("image", "component", "area")


def fill_small_holes(px: DataFrame, mask: str, ratio_limit: float) -> DataFrame:
    """Fills holes below the share of the image; adds filled."""
    total = px.groupBy("image").agg(F.count("*").alias("total"))
    background = label(px, mask, value=0, diagonal=False)
    small = holes(px, mask).join(total, "image").where(F.col("area") / F.col("total") < ratio_limit).select("image", "component")
    inside = background.join(small, ["image", "component"], "left_semi").select("image", "y", "x", F.lit(1).alias("hole"))
    return px.join(inside, ["image", "y", "x"], "left").withColumn("filled", F.when(F.col("hole") == 1, 1).otherwise(F.col(mask))).drop("hole")


def contour_length(on: DataFrame) -> DataFrame:
    """(image, contour): the length of the outline of the pixels in ``on`` (image, y, x), steps from pixel
    to pixel, diagonal ones sqrt(2). The frame counts as outside; parts one pixel thin count once."""
    df = on
    for i, (line, along) in enumerate(AXES):
        w = Window.partitionBy("image", line).orderBy(along)
        beside = F.coalesce(F.lag(along).over(w) == F.col(along) - 1, F.lit(False)) & F.coalesce(F.lead(along).over(w) == F.col(along) + 1, F.lit(False))
        df = df.withColumn(f"inner_{i}", beside)
    edge = cut(df.where(~(F.col("inner_0") & F.col("inner_1"))).select("image", "y", "x"))
    diagonals = None
    for dx in (1, -1):
        at = lambda dy, ddx: edge.select("image", (F.col("y") - dy).alias("y"), (F.col("x") - ddx).alias("x"))
        # Two pixels that touch at a corner only, without one beside both.
        met = edge.join(at(1, dx), ["image", "y", "x"]).join(at(1, 0), ["image", "y", "x"], "left_anti").join(at(0, dx), ["image", "y", "x"], "left_anti")
        diagonals = met if diagonals is None else diagonals.union(met)
    turns = diagonals.groupBy("image").agg(F.count("*").alias("d"))
    sized = edge.groupBy("image").agg(F.count("*").alias("n")).join(turns, "image", "left")
    return sized.select("image", (F.col("n") + F.coalesce("d", F.lit(0)) * (2**0.5 - 1)).alias("contour"))


def topology(px: DataFrame, mask: str, share: float = 0.05) -> DataFrame:
    """One row an image: pieces of at least ``share`` of the largest, their size_ratio and worst_solidity, holes, and
    of the largest piece (the first of equal ones) main_area, fill, aspect, contour, solidity and quad_fit. Images
    without mask pixels have no pieces."""
    runs = cut(labelled_runs(px, mask))
    inner = cut(hole_runs(labelled_runs(px, mask, value=0, diagonal=False), last_places(px)))
    filled = cut(filled_runs(runs, inner))
    areas = cut(run_areas(runs))
    main = areas.groupBy("image").agg(F.min_by(F.struct("component", "area", "x0", "x1", "y0", "y1"), F.struct(-F.col("area"), "component")).alias("m")).select("image", "m.*")
    pieces = areas.join(main.select("image", F.col("area").alias("top")), "image").where(F.col("area") >= share * F.col("top"))
    solid = cut(solidity(filled.join(pieces.select("image", "component"), ["image", "component"], "left_semi")))
    counts = pieces.join(solid, ["image", "component"]).groupBy("image").agg(F.count("*").alias("pieces"), F.try_divide(F.min("area"), F.max("area")).alias("size_ratio"), F.min("solidity").alias("worst_solidity"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    shapes = main.join(solid, ["image", "component"], "left").select("image", F.col("area").alias("main_area"), ratio(F.col("area"), w * h).alias("fill"), ratio(w, h).alias("aspect"), "solidity")
    of_main = lambda rows: rows.join(main.select("image", "component"), ["image", "component"], "left_semi")
    contours = contour_length(pixels_of(of_main(runs)).select("image", "y", "x"))
    fits = quad_fit(of_main(runs)).drop("quad")
    found = inner.groupBy("image").agg(F.count_distinct("component").alias("holes"))
    out = px.select("image").distinct()
    for part in (counts, shapes, contours, fits, found):
        out = out.join(part, "image", "left")
    return out.na.fill(0, ["pieces", "holes", "main_area"])


def edge_width(px: DataFrame, alpha: str, mask: str) -> DataFrame:
    """(image, uncertain, perimeter): pixels neither inside nor outside, and pixels that lie at the mask's outline."""
    near = boundary_band(px, mask, 3)
    uncertain = (F.col(alpha) > 0.05) & (F.col(alpha) < 0.95)
    return near.groupBy("image").agg(F.count_if(uncertain).alias("uncertain"), F.count_if("band").alias("perimeter"))


def boundary_contrast(px: DataFrame, mask: str, radius: int, least: int = 64) -> DataFrame:
    """(image, boundary_contrast): whether the colours on the two sides of the outline differ by more than the noise.

    Box means in Lab of the mask's side and of the other are compared along the outline, but for the
    frame; 0.5 where mask or outline have too few pixels or the mask fills the image.
    """
    scaled = lab(px).withColumns({"L": F.col("L") * 2.55, "m": F.col(mask).cast("double")})
    inside, outside = F.col("m"), 1 - F.col("m")
    sides = {f"{side}_{c}": F.col(c) * w for side, w in (("in", inside), ("out", outside)) for c in ("L", "a", "b_")}
    df = means(scaled, sides | {"in_w": inside, "out_w": outside, "mean_l": F.col("L"), "mean_l2": F.col("L") * F.col("L")}, radius)
    df = boundary_band(df, mask, 3).join(last_places(px), "image")
    of = lambda side, c: F.col(f"{side}_{c}") / F.greatest(F.col(f"{side}_w"), F.lit(1e-3))
    step = F.sqrt(sum((F.pow(of("in", c) - of("out", c), 2) for c in ("L", "a", "b_")), F.lit(0.0)))
    noise = F.sqrt(F.greatest(F.col("mean_l2") - F.col("mean_l") * F.col("mean_l"), F.lit(0.0))) + 1.5
    free = (F.least("y", "x", F.col("h") - F.col("y"), F.col("w") - F.col("x")) > radius) & F.col("band")
    sums = df.groupBy("image").agg(F.sum("m").alias("on"), F.avg("m").alias("share"), F.count_if(free).alias("n"), F.avg(F.when(free, (step < noise).cast("double"))).alias("flat"))
    known = (F.col("on") >= least) & (F.col("share") <= 0.98) & (F.col("n") >= least)
    return sums.select("image", F.when(known, falling(F.col("flat"), 0.06, 0.34)).otherwise(0.5).alias("boundary_contrast"))


def suppress_shadow(px: DataFrame, alpha: str, least: int = 200, least_shadow: int = 300) -> DataFrame:
    """Sets ``alpha`` to 0 where a cast shadow was taken for the object; adds shadow_suppressed.

    A shadow is soft, without colour, a little darker than the backdrop and away from the solid body.
    Images with too few soft, solid, backdrop or shadow pixels stay as they are.
    """
    v, low, a = F.greatest("r", "g", "b") / 255.0, F.least("r", "g", "b") / 255.0, F.col(alpha)
    df = px.withColumns({"sh_v": v, "sh_s": F.when(v == 0, 0.0).otherwise((v - low) / v), "sh_body": (a > 0.6).cast("int")})
    backdrop = df.groupBy("image").agg(F.count_if((a > 0.08) & (a < 0.75)).alias("soft"), F.count_if(a > 0.9).alias("solid"), F.count_if(a < 0.02).alias("empty"), F.median(F.when(a < 0.02, F.col("sh_v"))).alias("bg"))
    df = dilate(df, "sh_body", 8, "sh_near").join(backdrop, "image")
    dim = (a > 0.08) & (a < 0.75) & (F.col("sh_s") < 0.18) & (F.col("sh_v") < F.col("bg") - 0.02) & (F.col("sh_v") > F.col("bg") - 0.42)
    df = df.withColumn("sh_dim", F.coalesce(dim, F.lit(False))).withColumn("sh_target", F.col("sh_dim") & (F.col("sh_near") == 0))
    df = cut(df)
    counted = df.groupBy("image").agg(F.count_if("sh_dim").alias("sh_dims"), F.count_if("sh_target").alias("sh_targets"))
    gate = (F.least("soft", "solid", "empty") >= least) & (F.least("sh_dims", "sh_targets") >= least_shadow)
    df = df.join(counted, "image").withColumn("shadow_suppressed", gate)
    return df.withColumn(alpha, F.when(F.col("shadow_suppressed") & F.col("sh_target"), 0.0).otherwise(a)).select(*px.columns, "shadow_suppressed")


def weighted_low_pass(px: DataFrame, value: str, alpha: str, radius: int, out: str) -> DataFrame:
    """Smooths ``value`` over the pixels that ``alpha`` says belong to the object: three box passes stand for a Gaussian."""
    df = px.withColumns({"wl_n": F.col(value) * F.col(alpha), "wl_d": F.col(alpha).cast("double")})
    for _ in range(3):
        df = means(df, {"wl_n": F.col("wl_n"), "wl_d": F.col("wl_d")}, radius)
    return df.withColumn(out, F.col("wl_n") / F.greatest(F.col("wl_d"), F.lit(1e-4))).drop("wl_n", "wl_d")


def shrink(px: DataFrame, most: int = 480, least: int = 8) -> DataFrame:
    """The pixels of an image whose long edge is ``most`` at the most, by nearest sampling; short edges keep ``least``."""
    df = px.join(last_places(px).select("image", (F.col("h") + 1).alias("sk_y"), (F.col("w") + 1).alias("sk_x")), "image")
    long, kept = F.greatest("sk_y", "sk_x"), []
    for c in ("y", "x"):
        n = F.col(f"sk_{c}")
        to = F.when(long <= most, n).otherwise(F.greatest(F.lit(least), F.round(n * most / long))).cast("long")
        place = F.ceil(F.col(c) * to / n)
        kept.append((place, (F.floor(place * n / to) == F.col(c)) & (place < to)))
    df = df.where(kept[0][1] & kept[1][1]).withColumns({"sk_ny": kept[0][0], "sk_nx": kept[1][0]})
    return df.select(*[F.col(f"sk_n{c}").cast(px.schema[c].dataType).alias(c) if c in ("y", "x") else c for c in px.columns])


def longest_column_run(px: DataFrame, mask: str, share: float = 0.92, gap: int = 2) -> DataFrame:
    """(image, x0, x1): the longest run of columns of which ``share`` of the tallest column is covered."""
    columns = px.groupBy("image", "x").agg(F.sum(mask).alias("n"))
    top = columns.groupBy("image").agg(F.max("n").alias("top"))
    full = columns.join(top, "image").where((F.col("n") > share * F.col("top")) & (F.col("top") > 0))
    w = Window.partitionBy("image").orderBy("x")
    runs = full.withColumn("run", F.sum(F.coalesce((F.col("x") - F.lag("x").over(w) > gap).cast("int"), F.lit(0))).over(w))
    spans = runs.groupBy("image", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return spans.groupBy("image").agg(F.max_by(F.struct("x0", "x1"), F.struct((F.col("x1") - F.col("x0")).alias("n"), (-F.col("x0")).alias("first"))).alias("s")).select("image", "s.x0", "s.x1")


def gradient(px: DataFrame, value: str) -> DataFrame:
    """Adds magnitude: the Sobel gradient, the frame's pixels repeated outwards."""
    return slopes(px, value).withColumn("magnitude", F.hypot("gx", "gy")).drop("gx", "gy")


def edge_alignment(px: DataFrame, grey: str, mask: str, tolerance: int) -> DataFrame:
    """Share of the outline with a strong gradient near it, after smoothing; outlines under 32 pixels score 0."""
    smooth = convolve(outline(px, mask), grey, gaussian(1.0), "smooth")
    graded = dilate(gradient(smooth, "smooth"), "magnitude", tolerance, "strongest")
    graded = cut(graded)
    stats = percentiles(graded, "magnitude", ["image"], {"mid": 0.5, "top": 0.99})
    level = F.greatest(2.5 * F.col("mid"), 0.06 * F.col("top"), F.lit(1.5))
    on = graded.where("edge = 1").join(stats, "image").groupBy("image").agg(F.count("*").alias("n"), F.avg((F.col("strongest") >= level).cast("double")).alias("hit"))
    return px.select("image").distinct().join(on, "image", "left").select("image", F.when(F.col("n") >= 32, F.col("hit")).otherwise(0.0).alias("edge_alignment"))


def lab(px: DataFrame) -> DataFrame:
    """Adds L (0-100), a, b of the sRGB columns r, g, b (0-255), D65."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))
    r, g, b = (linear(F.col(c) / 255.0) for c in "rgb")
    xyz = {"lab_x": (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, "lab_y": 0.212671 * r + 0.715160 * g + 0.072169 * b, "lab_z": (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754}
    f = lambda t: F.when(F.col(t) > 0.008856, F.cbrt(t)).otherwise(7.787 * F.col(t) + 16.0 / 116)
    df = px.withColumns(xyz)
    return df.withColumns({"L": 116 * f("lab_y") - 16, "a": 500 * (f("lab_x") - f("lab_y")), "b_": 200 * (f("lab_y") - f("lab_z"))}).drop(*xyz)


def background_consistency(px: DataFrame, mask: str, ring: int, edge: int) -> DataFrame:
    """Share of the pixels just outside the mask that look like the frame's border; 0.5 where that can't be told.

    The border's model is median and scaled median deviation of L, a and b; darker pixels pass as shadow.
    """
    near = dilate(lab(px), mask, ring, "near").join(last_places(px), "image")
    frame = near.where((F.col(mask) == 0) & ((F.col("y") < edge) | (F.col("x") < edge) | (F.col("y") > F.col("h") - edge) | (F.col("x") > F.col("w") - edge)))
    mid = frame.groupBy("image").agg(F.count("*").alias("n"), *[F.median(c).alias(f"mid_{c}") for c in ("L", "a", "b_")])
    spread = frame.join(mid, "image").groupBy("image").agg(*[F.greatest(1.4826 * F.median(F.abs(F.col(c) - F.col(f"mid_{c}"))), F.lit(1.0)).alias(f"mad_{c}") for c in ("L", "a", "b_")])
    off = lambda c: F.col(c) - F.col(f"mid_{c}")
    like = (F.abs(off("a")) <= 3 * F.col("mad_a")) & (F.abs(off("b_")) <= 3 * F.col("mad_b_")) & (off("L") <= 3 * F.col("mad_L"))
    ringed = near.where((F.col(mask) == 0) & (F.col("near") == 1)).join(mid, "image").join(spread, "image")
    found = ringed.groupBy("image").agg(F.avg(like.cast("double")).alias("outside_is_background"))
    out = px.select("image").distinct().join(found, "image", "left")
    return out.select("image", F.coalesce(clip((F.col("outside_is_background") - 0.35) / 0.5), F.lit(0.5)).alias("bg_consistency"))


def skin(px: DataFrame) -> Column:
    """Whether the colours r, g, b look like skin or dark hair."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cr, cb = (r - y) * 0.713 + 128, (b - y) * 0.564 + 128
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    saturation = F.when(v == 0, 0.0).otherwise(255.0 * (v - low) / v)
    return ((cr > 133) & (cr < 180) & (cb > 77) & (cb < 130)) | ((v < 62) & (saturation < 110))


def thumbnail(px: DataFrame, value: str, factor: int) -> DataFrame:
    """Area means of blocks of factor x factor pixels."""
    at = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return px.select("image", *at, value).groupBy("image", "y", "x").agg(F.avg(value).alias(value))


def composite(base: Column, layer: Column, alpha: Column) -> Column:
    return base * (1 - alpha) + layer * alpha
