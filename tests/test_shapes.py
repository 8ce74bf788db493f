"""Windows, runs, hulls, rectangles, edges and distances against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.operators import edges, pixels, printarea, regions, shapes, windows


def grid(spark, *arrays, names=("m",)):
    """Arrays of one shape as an image; several shapes need several calls."""
    rows = [(0, y, x, *[v.item() for v in values]) for (y, x), values in ((at, [a[at] for a in arrays]) for at in np.ndindex(arrays[0].shape))]
    return spark.createDataFrame(rows, "image int, y int, x int, " + ", ".join(f"{n} {'long' if a.dtype.kind in 'iub' else 'double'}" for n, a in zip(names, arrays, strict=True)))


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", name).collect():
        out[r.y, r.x] = r[name]
    return out


@pytest.mark.parametrize("radius", [1, 3, 6, 11, 40])
def test_windows_of_any_radius(spark, monkeypatch, radius):
    monkeypatch.setattr(windows, "NEAR", 0)
    rng = np.random.default_rng(radius)
    a, b = rng.random((13, 29)), rng.integers(-9, 9, (13, 29))
    around = lambda f, v: np.array([[f(v[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]) for x in range(29)] for y in range(13)])
    px = grid(spark, a, b, names=("a", "b"))
    found = windows.extremes(windows.means(px, {"mean": F.col("a"), "both": F.col("a") * F.col("b")}, radius), {"low": ("b", F.min), "high": ("a", F.max)}, radius).cache()
    for name, f, v in (("mean", np.mean, a), ("both", np.mean, a * b), ("low", np.min, b), ("high", np.max, a)):
        assert back(found, name, a.shape) == pytest.approx(around(f, v))


def test_closing_and_opening(spark):
    m = np.zeros((12, 12), int)
    m[3:9, 2:10] = 1
    m[5, 5], m[0, 11] = 0, 1
    px = grid(spark, m)
    closed, opened = back(pixels.closing(px, "m", 1, "c"), "c", m.shape), back(pixels.opening(px, "m", 1, "c"), "c", m.shape)
    assert closed[5, 5] == 1 and closed[3:9, 2:10].all() and opened[0, 11] == 0 and opened[3, 2] == 1


def biggest(m):
    best = 0
    for y0, x0 in np.ndindex(m.shape):
        for y1, x1 in itertools.product(range(y0, m.shape[0]), range(x0, m.shape[1])):
            if m[y0 : y1 + 1, x0 : x1 + 1].all():
                best = max(best, (y1 - y0 + 1) * (x1 - x0 + 1))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_largest_rectangle(spark, seed):
    m = (np.random.default_rng(seed).random((9, 11)) < 0.8).astype(int)
    r = shapes.largest_rectangle(grid(spark, m), "m").first()
    assert r.area == biggest(m) == r.width * r.height and m[r.y : r.y + r.height, r.x : r.x + r.width].all()
    assert shapes.largest_rectangle(grid(spark, m * 0), "m").count() == 0


def test_a_stack_finds_rectangles_under_bars():
    assert shapes.widest_under([0, 1, 2, 5, 6], [3, 1, 3, 2, 2])[0] == 4
    assert shapes.widest_under([4, 5, 6, 7], [2, 2, 2, 2]) == (8, -4, 4, 2)
    assert shapes.widest_under([], []) == (0, 0, 0, 0)


def hull_area(points):
    """By gift wrapping over the points' convex position."""
    points = sorted(set(points))
    chain = lambda ps: [ps[0]] if len(ps) == 1 else _half(ps)

    def _half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = chain(points)[:-1] + chain(points[::-1])[:-1]
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def inside_outline(m):
    """Squares of four centres of a mask without holes: all in 1, three 1/2."""
    n = m[1:, 1:] + m[:-1, 1:] + m[1:, :-1] + m[:-1, :-1]
    return (n == 4).sum() + (n == 3).sum() / 2


def drawn(name):
    y, x = np.mgrid[0:40, 0:50]
    return {
        "rectangle": (y >= 5) & (y < 30) & (x >= 8) & (x < 41),
        "disc": (y - 20) ** 2 + (x - 22) ** 2 <= 225,
        "letter c": (y >= 4) & (y < 36) & (x >= 5) & (x < 40) & ~((y >= 12) & (y < 28) & (x >= 14)),
        "turned": (np.abs((x - 25) * 0.8 + (y - 20) * 0.6) <= 15) & (np.abs((y - 20) * 0.8 - (x - 25) * 0.6) <= 7),
        "diamond": np.abs(y - 20) + np.abs(x - 25) <= 12,
        "line": (y == 7) & (x > 3) & (x < 30),
        "point": (y == 9) & (x == 9),
    }[name].astype(int)


@pytest.mark.parametrize("name", ["rectangle", "disc", "letter c", "turned", "diamond", "line", "point"])
def test_topology_of_shapes(spark, name):
    m = drawn(name)
    t = pixels.topology(grid(spark, m), "m").first()
    around = hull_area([tuple(map(int, p)) for p in np.argwhere(m)]) if m.sum() > 1 and name != "line" else 0
    want = inside_outline(m) / around if around else 0.0
    assert (t.solidity, t.worst_solidity, t.pieces, t.holes) == (pytest.approx(want), pytest.approx(want), 1, 0)
    if name in ("rectangle", "diamond"):
        assert (t.solidity, t.quad_fit) == (1.0, 1.0)
    if name == "turned":
        # Its steps take a pixel off sides of 31 and 15.
        assert t.solidity > 0.93 and t.quad_fit > 0.85
    if name in ("letter c", "disc"):
        assert t.quad_fit < 0.8


def test_holes_are_filled_for_solidity(spark):
    m = drawn("disc")
    pierced = m.copy()
    pierced[15:20, 18:24] = 0
    whole, holed = (pixels.topology(grid(spark, a), "m").first() for a in (m, pierced))
    assert holed.holes == 1 and holed.solidity == pytest.approx(whole.solidity) and holed.main_area == whole.main_area - 30


def test_several_pieces(spark):
    m = drawn("rectangle") * 0
    m[2:12, 2:12], m[20:30, 5:35], m[24:30, 10:35], m[38, 48] = 1, 1, 0, 1
    t = pixels.topology(grid(spark, m), "m").first()
    assert t.pieces == 2 and t.solidity < 0.6 and t.worst_solidity == t.solidity and t.size_ratio == pytest.approx(100 / 150)


def test_least_rectangle_and_corners(spark):
    ring = [(0.0, 3.0), (4.0, 0.0), (10.0, 8.0), (6.0, 11.0)]
    df = spark.createDataFrame([([{"y": y, "x": x} for y, x in ring],), ([{"y": 0.0, "x": 0.0}, {"y": 1.0, "x": 1.0}],)], "hull " + shapes.POINTS)
    found = df.select(shapes.least_rectangle(F.col("hull")).alias("r"), shapes.four_corners(F.col("hull")).alias("q"), shapes.polygon_area(F.col("hull")).alias("a")).collect()
    assert sorted((round(p.y, 9), round(p.x, 9)) for p in found[0].r) == sorted(ring) and found[0].a == pytest.approx(50)
    assert [(p.y, p.x) for p in found[0].q] == ring and found[1].r is None and found[1].q is None


def test_distances(spark):
    rng = np.random.default_rng(5)
    m = (rng.random((17, 23)) < 0.03).astype(int)
    at = np.argwhere(m)
    want = np.array([[min((y - p[0]) ** 2 + (x - p[1]) ** 2 for p in at) for x in range(23)] for y in range(17)])
    assert (back(edges.squared_distances(grid(spark, m), "m"), "squared", m.shape) == want).all()
    none = edges.squared_distances(grid(spark, m * 0), "m").collect()
    assert len(none) == m.size and {r.squared for r in none} == {None}


def test_lower_envelope():
    rng = np.random.default_rng(6)
    for _ in range(200):
        xs = sorted(rng.choice(30, rng.integers(1, 12), replace=False).tolist())
        hs = rng.integers(0, 200, len(xs)).tolist()
        assert edges.nearest_squares(xs, hs, 30) == [min((p - x) ** 2 + h for x, h in zip(xs, hs)) for p in range(30)]


def test_convolution_mirrors_the_border(spark):
    v = np.random.default_rng(7).random((9, 12))
    kernel = edges.gaussian(1.0)
    assert len(kernel) == 9 and sum(kernel) == pytest.approx(1)
    padded = np.pad(v, 4, mode="reflect")
    rows = sum(w * padded[:, k : k + 12] for k, w in enumerate(kernel))
    want = sum(w * rows[k : k + 9] for k, w in enumerate(kernel))
    assert back(edges.convolve(grid(spark, v, names=("v",)), "v", kernel, "o"), "o", v.shape) == pytest.approx(want)
    assert back(edges.convolve(grid(spark, np.full((1, 3), 2.0), names=("v",)), "v", kernel, "o"), "o", (1, 3)) == pytest.approx(2)


def test_edges_are_thin_and_agree_with_their_shift(spark):
    m = drawn("rectangle")
    found = edges.edges(grid(spark, m * 255, names=("v",)), "v").collect()
    assert 2 * (25 + 33) - 8 <= len(found) <= 2 * (25 + 33) + 8
    assert all(min(abs(r.y - 5), abs(r.y - 29), abs(r.x - 8), abs(r.x - 40)) <= 1 for r in found)
    shifted = np.roll(m, 2, axis=1)
    both = grid(spark, m, shifted, names=("a", "b"))
    near, far = edges.edge_f1(both, "a", "b", 2).first().edge_f1, edges.edge_f1(both, "a", "b", 1).first().edge_f1
    assert near == 1 and far < 0.75
    assert edges.edge_f1(grid(spark, m, m * 0, names=("a", "b")), "a", "b", 3).first().edge_f1 == 0


def test_weak_edges_need_a_strong_pixel(spark):
    ramp = np.zeros((20, 20))
    ramp[:, 10:] = np.linspace(15, 60, 20)[:, None]
    strong, weak = edges.edges(grid(spark, ramp, names=("v",)), "v", 50, 150).count(), edges.edges(grid(spark, np.minimum(ramp, 30.0), names=("v",)), "v", 50, 150).count()
    assert strong >= 18 and weak == 0


def test_runs_of_regions(spark):
    runs = regions.labelled_runs(grid(spark, drawn("letter c")), "m")
    assert regions.run_areas(runs).first().area == drawn("letter c").sum() and runs.count() == 32
    assert math.isclose(shapes.outline_areas(runs).first().outlined, inside_outline(drawn("letter c")))


def coloured(spark, m, colour):
    """A mask and a colour for each pixel, white outside."""
    rows = [(0, y, x, int(v), *(colour(y, x) if v else (255, 255, 255))) for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "image int, y int, x int, m int, r int, g int, b int")


def worn(m, r):
    return np.array([[m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].min() for x in range(m.shape[1])] for y in range(m.shape[0])])


def test_a_mug_is_printed_beside_its_handle(spark):
    m = np.zeros((60, 80), int)
    m[8:52, 10:50] = 1
    m[18:42, 50:64] = 1
    m[23:37, 52:60] = 0
    r = printarea.cylinder_areas(coloured(spark, m, lambda y, x: (90, 90, 200)), "m").first()
    # The body of 40 x 44 pixels loses two on each side, then the wall's edges.
    (x, y), (x1, _), (_, y1), _ = r.quad
    assert (x, y) == (pytest.approx(12 + 0.14 * 36), pytest.approx(10 + 0.14 * 40)) and (x1 - x, y1 - y) == (pytest.approx(0.72 * 36), pytest.approx(0.70 * 40))
    # The first two columns of the handle are as full as the body's.
    assert r.confidence == pytest.approx(0.5 * (0.72 * 36 * 0.70 * 40) / worn(np.where(np.arange(80) < 52, m, 0), 2).sum() + 0.45) and x1 < 50
    assert printarea.cylinder_areas(coloured(spark, m * 0, lambda y, x: (0, 0, 0)), "m").count() == 0


def shirt():
    m = np.zeros((70, 90), int)
    m[5:65, 25:65] = 1
    m[5:25, 5:85] = 1
    return m


def test_a_shirt_is_printed_on_its_chest(spark):
    m = shirt()
    r = printarea.torso_areas(coloured(spark, m, lambda y, x: (60, 120, 220)), "m").first()
    (x, y), (x1, _), (_, y1), _ = r.quad
    assert worn(m, 2)[int(y) : math.ceil(y1), int(x) : math.ceil(x1)].all() and 25 < x < x1 < 65 and 5 + 0.16 * 60 <= y < y1 <= 5 + 0.78 * 60
    arm = lambda y, x: (200, 140, 110) if y > 35 and x > 52 else (60, 120, 220)
    spared = printarea.torso_areas(coloured(spark, m, arm), "m").first()
    (x, y), (x1, _), (_, y1), _ = spared.quad
    assert not (x1 > 48 and y1 > 31) and 0.4 <= spared.confidence <= r.confidence <= 1
    # A dark shirt looks like hair all over; that says nothing, so it keeps its chest.
    dark = printarea.torso_areas(coloured(spark, m, lambda y, x: (20, 20, 22)), "m").first()
    assert dark.quad == r.quad


def test_categories_from_silhouettes(spark):
    from assetloom.operators import routing

    def choice(m, colour):
        px = coloured(spark, m, colour)
        scores = printarea.category_scores()
        measured = pixels.topology(px, "m").join(printarea.category_measures(px, "m"), "image").withColumns(scores)
        best, _ = routing.category_choice(F.create_map(*[x for k in scores for x in (F.lit(k), F.col(k))]), list(scores))
        return measured.select(best.alias("best")).first().best

    canvas, mug = np.zeros((60, 80), int), np.zeros((60, 80), int)
    canvas[5:55, 6:74] = 1
    mug[8:52, 10:50], mug[18:42, 50:64] = 1, 1
    mug[23:37, 52:60] = 0
    assert choice(canvas, lambda y, x: (200, 40, 30)) == "wall_art"
    assert choice(mug, lambda y, x: (235, 235, 235)) == "drinkware"
    assert choice(shirt(), lambda y, x: (200, 140, 110) if y < 9 else (30, 90, 200)) == "apparel"
