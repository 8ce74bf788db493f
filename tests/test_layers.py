"""Shading, displacement and cut-outs against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.operators import layers


def table_of(spark, arrays: dict, image=0):
    first = next(iter(arrays.values()))
    rows = [(image, y, x, *[float(a[y, x]) for a in arrays.values()]) for y, x in np.ndindex(first.shape)]
    return spark.createDataFrame(rows, "image int, y int, x int, " + ", ".join(f"{k} double" for k in arrays))


def back(df, name, shape, image=0):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("image") == image).select("y", "x", name).collect():
        out[r.y, r.x] = r[name]
    return out


def axis(a):
    """What two places of one axis, in cells, weigh for each other on the grid."""
    lo, f = np.floor(a), a - np.floor(a)
    out = 0
    for i, wi in ((0, 1 - f), (1, f)):
        for j, wj in ((0, 1 - f), (1, f)):
            out = out + np.multiply.outer(wi, wj) * (abs(np.subtract.outer(lo + i, lo + j)) <= 1)
    return out


def direct(value, weight, space, level=None, gauss=False):
    """Means by all pairs, with the grid's weights or with a Gaussian's."""
    h, w = value.shape
    ys, xs = (v.ravel() / space for v in np.mgrid[0:h, 0:w])
    axes = [ys, xs] + ([level.ravel()] if level is not None else [])
    k = math.prod(np.exp(-(np.subtract.outer(a, a) ** 2) / 2) if gauss else axis(a) for a in axes)
    n, d, s = k.sum(1), k @ weight.ravel(), k @ (weight * value).ravel()
    return (s / np.maximum(d, layers.LEAST_WEIGHT * n)).reshape(h, w)


@pytest.mark.parametrize("levels", [False, True])
def test_grid_means(spark, levels):
    rng = np.random.default_rng(3)
    v, w = rng.random((17, 23)), (rng.random((17, 23)) < 0.6).astype(float)
    px = table_of(spark, {"v": v, "w": w})
    found = layers.grid_means(px, {"out": F.col("v"), "two": 2 * F.col("v")}, F.col("w"), F.lit(3.5), F.col("v") / 0.2 if levels else None)
    want = direct(v, w, 3.5, v / 0.2 if levels else None)
    assert back(found, "out", v.shape) == pytest.approx(want) and back(found, "two", v.shape) == pytest.approx(2 * want)


def test_a_grid_is_near_a_gaussian(spark):
    y, x = np.mgrid[0:48, 0:48]
    v = np.where(x < 24, 0.3, 0.7) + 0.05 * np.sin(y / 3.0)
    found = back(layers.bilateral(table_of(spark, {"v": v}), "v", F.lit(4.0), 0.1, "out"), "out", v.shape)
    assert abs(found - direct(v, np.ones_like(v), 4.0, v / 0.1, gauss=True)).max() < 0.006
    # The step stays a step.
    assert (found[:, 24] - found[:, 23]).min() > 0.38


def test_the_width_may_differ_by_image(spark):
    v = np.random.default_rng(5).random((12, 12))
    px = table_of(spark, {"v": v}).union(table_of(spark, {"v": v}, image=1)).withColumn("s", F.when(F.col("image") == 0, 2.0).otherwise(5.0))
    found = layers.grid_means(px, {"out": F.col("v")}, F.lit(1.0), F.col("s")).cache()
    assert back(found, "out", v.shape) == pytest.approx(direct(v, np.ones_like(v), 2.0))
    assert back(found, "out", v.shape, 1) == pytest.approx(direct(v, np.ones_like(v), 5.0))


def picture(shape=(40, 40)):
    """A grey block with a dark and a light fold on white."""
    a, grey = np.zeros(shape), np.full(shape, 255.0)
    a[5:35, 5:35], grey[5:35, 5:35] = 1, 128
    grey[5:35, 14:16], grey[5:35, 24:26] = 70, 200
    return a, grey


def test_folds_are_in_their_layers(spark):
    a, grey = picture()
    px = table_of(spark, {"alpha": a, "r": grey, "g": grey, "b": grey})
    found = layers.light_layers(px, "alpha").cache()
    shadow, highlight = back(found, "shadow", a.shape), back(found, "highlight", a.shape)
    assert shadow[20, 14] > 0.8 > 0.3 > shadow[20, 8] and highlight[20, 24] > 0.8 > 0.3 > highlight[20, 8]
    assert not shadow[a == 0].any() and not highlight[a == 0].any() and max(shadow.max(), highlight.max()) <= 1
    report = layers.light_report(found, "alpha").first()
    assert report.albedo_sigma_px == 6.0 and 0 < report.shadow_mean < 0.5
    assert report.shadow_mean == round(shadow[a == 1].mean(), 4)


def test_smoothing_moves_no_pixels_of_small_images(spark, monkeypatch):
    a, grey = picture()
    px = table_of(spark, {"alpha": a, "r": grey, "g": grey, "b": grey})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    plain = layers.cut
    monkeypatch.setattr(layers, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    try:
        near = layers.light_layers(px, "alpha")
        moves = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert moves and all("REPARTITION_BY_NUM" in line for line in moves)
        monkeypatch.setattr(layers, "LARGE", 1)  # an image too large for one task is smoothed all the same
        far = layers.light_layers(px, "alpha")
        for c in ("shadow", "highlight"):
            assert np.abs(back(near, c, a.shape) - back(far, c, a.shape)).max() < 1e-9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_displacement_is_neutral_outside(spark):
    a, grey = picture()
    found = back(layers.displacement(table_of(spark, {"alpha": a, "r": grey, "g": grey, "b": grey}), "alpha"), "displacement", a.shape)
    assert (found[a == 0] == layers.NEUTRAL).all() and found[20, 14] < 60 and found[20, 24] > 180 and found.min() >= 0 and found.max() <= 255


def test_images_with_little_in_them(spark):
    a, grey = np.zeros((6, 9)), np.full((6, 9), 90.0)
    a[2, 2:5] = 1
    px = table_of(spark, {"alpha": a, "r": grey, "g": grey, "b": grey})
    assert layers.light_layers(px, "alpha").agg(F.sum("shadow") + F.sum("highlight")).first()[0] == 0
    assert [r[0] for r in layers.displacement(px, "alpha").select("displacement").distinct().collect()] == [128]
    cut = layers.cut_out(px, "alpha").first()
    assert (cut.cut_r, cut.cut_g, cut.cut_b) == (90, 90, 90)
    empty = px.limit(0)
    for f in (layers.light_layers, layers.displacement, layers.cut_out):
        assert f(empty, "alpha").count() == 0


def test_nearest_pixel_of_a_mask(spark):
    rng = np.random.default_rng(8)
    m = (rng.random((15, 19)) < 0.06).astype(float)
    found = layers.nearest_marked(table_of(spark, {"m": m, "v": rng.random(m.shape)}), "m", ["v"], 19).collect()
    on = [tuple(p) for p in np.argwhere(m == 1)]
    for r in found:
        want = min(((r.y - y) ** 2 + (r.x - x) ** 2, y, x) for y, x in on)
        assert (r.near.squared, r.near.y, r.near.x) == want


def test_fringes_take_the_colour_of_the_core(spark):
    y, x = np.mgrid[0:40, 0:40]
    far = np.hypot(y - 20, x - 20)
    a = np.clip((14 - far) / 4, 0, 1)
    red, rest = np.where(a > 0.85, 200.0 - y, 255.0), np.where(a > 0.85, 10.0, 255.0)
    rows = layers.cut_out(table_of(spark, {"alpha": a, "r": red, "g": rest, "b": rest}), "alpha").collect()
    core = np.argwhere(a > 0.85)
    changed = 0
    for r in rows:
        if 0.01 < r.alpha < 0.85:
            squared, ny, nx = min(((r.y - cy) ** 2 + (r.x - cx) ** 2, cy, cx) for cy, cx in core)
            assert (r.cut_r, r.cut_g) == (int(red[ny, nx]), 10)
            changed += 1
        else:
            assert (r.cut_r, r.cut_g) == (int(r.r), int(r.g))
        assert r.cut_a == math.floor(r.alpha * 255 + 0.5)
    assert changed > 100
