"""Operators on small inputs with known results, and replays of published result rows."""

import json
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetloom.functions import columns as c
from assetloom.operators import curation, evaluation, pixels, reporting, routing
from assetloom.operators.components import connected_components
from assetloom.schema import CATEGORIES, RESULT_COLUMNS, RESULT_SCHEMA, TAXONOMY, Settings, taxonomy
from assetloom.session import shared_dir
from assetloom.sources import images, manifests, sinks
from assetloom.streaming import progress

#: Published result rows and splits, kept as golden values.
DATA = Path(__file__).parent / "data"


def read(name):
    return [json.loads(x) for x in (DATA / name).read_text().splitlines()]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


# --- replays


def test_published_scores_and_verdicts(spark):
    rows = read("scored_masks.jsonl")
    flat = [r | {k: v for k, v in r["terms"].items() if k not in ("coverage", "ensemble")} | {"shadow_suppressed": r["shadow"]} for r in rows]
    for r in flat:
        r.pop("terms")
    df = spark.createDataFrame(flat, ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in flat[0].items()))
    got = {r.id: r for r in routing.assess(df).collect()}
    assert len(got) == 19
    for r in rows:
        assert got[r["id"]].confidence == pytest.approx(r["confidence"], abs=3e-4)
        assert (got[r["id"]].verdict, got[r["id"]].veto) == (r["verdict"], r["vetoed"])
    assert Counter(r.verdict for r in got.values()) == {"READY": 14, "REVIEW": 5}


def test_published_accuracy_summary(spark):
    df = spark.createDataFrame(read("accuracy_rows.jsonl"))
    s = evaluation.accuracy_summary(df, "iou", "latency_ms").first()
    assert (round(s.mean_iou, 4), round(s.median_iou, 4), s.min_iou, round(s.mean_latency, 1), round(s.p95_latency, 1)) == (0.9269, 0.9985, 0.3597, 2354.4, 2970.8)
    assert [round(s[f"iou_at_{t}"], 4) for t in (50, 75, 90, 95)] == [0.9474, 0.8947, 0.7895, 0.7895]
    assert round(evaluation.rank_correlation(df, "confidence", "iou", "file").first().rank_correlation, 3) == 0.812
    by = {r.verdict: (r["count"], round(r.share, 4), round(r.mean_iou, 4), r.min_iou) for r in evaluation.by_verdict(df).collect()}
    assert by == {"READY": (14, 0.7368, 0.9975, 0.9834), "REVIEW": (5, 0.2632, 0.7294, 0.3597)}
    assert {r.accuracy for r in evaluation.by_category(df).collect()} == {1.0}


def test_published_split(spark):
    rows = [x.split("\t") for x in (DATA / "split_rows.tsv").read_text().splitlines()]
    parts = [(i, i.split("_"), s) for i, s in rows]
    df = spark.createDataFrame([(i, f"{p[1]}_{p[-1]}", s) for i, p, s in parts], "id string, grp string, split string")
    assert curation.leaking_groups(df, "grp").count() == 0
    want = {r.grp: r.split for r in df.select("grp", "split").distinct().collect()}
    assert len(want) == 32
    got = curation.group_split(df, "grp", order=curation.seeded_order(df, "grp", 42)).collect()
    assert {r.grp: r.split for r in got} == want
    total = Counter()
    for r in got:
        total[r.split] += r.n
    assert total == {"train": 84, "val": 19, "test": 18}


# --- scoring


BASE = dict(category="apparel", coverage=0.4, edge_alignment=1.0, sharpness=1.0, topology=1.0, border=1.0, bg_consistency=1.0, shape_prior=1.0, boundary_contrast=1.0, iou=None, boundary_f1=None, component_penalty=0.0, multi_instance=False, hole_penalty=0.0, border_contact=0.0, complexity=0.0, shadow_suppressed=False)
SCHEMA = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in BASE.items())


def assessed(spark, *changes):
    return routing.assess(spark.createDataFrame([BASE | x for x in changes], SCHEMA).coalesce(1)).collect()


def test_verdicts(spark):
    def one(**change):
        return assessed(spark, change)[0]

    assert (one().verdict, one().confidence, one().reasons) == ("READY", 1.0, ["clean"])
    assert one(coverage=0.001).reasons == ["no_product"] and one(coverage=0.99).reasons == ["covers_whole_frame"]
    assert (one(coverage=0.0).verdict, one(coverage=0.0).confidence) == ("FAILED", 0.0)
    r = one(component_penalty=0.5)
    assert (r.verdict, r.veto, r.reasons) == ("REVIEW", True, ["split_into_pieces"])
    assert one(multi_instance=True).reasons == ["several_products"]
    assert one(iou=0.5, boundary_f1=0.5).reasons == ["second_model_disagrees"]
    low = one(edge_alignment=0.0, sharpness=0.0, boundary_contrast=0.0, topology=0.0)
    assert low.verdict == "FAILED" and low.reasons[0] == "below_floor" and low.reasons[1:4] == ["outline_off_edges", "soft_edge", "cuts_through_object"]
    assert one(category="spaceship", coverage=0.05).confidence == 1.0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=8, max_size=8))
def test_confidence_is_bounded_and_verdict_follows_it(spark, xs):
    names = ["edge_alignment", "sharpness", "topology", "border", "bg_consistency", "shape_prior", "boundary_contrast", "complexity"]
    r = assessed(spark, dict(zip(names, xs, strict=True)))[0]
    assert 0 <= r.confidence <= 1
    assert r.verdict == "READY" if r.confidence > 0.8201 and not r.veto else r.verdict in ("REVIEW", "FAILED") or abs(r.confidence - 0.82) < 1e-3


def test_score_helpers(spark):
    v = lambda col: value(spark, col)
    lit = F.lit
    assert v(c.band_score(lit(0.5), lit(0.2), lit(0.6), 0.3)) == 1 and v(c.band_score(lit(0.75), lit(0.2), lit(0.6), 0.3)) == pytest.approx(0.5)
    assert v(c.coverage_score(lit(0.05), lit(0.1), lit(0.9))) == pytest.approx(0.5) and v(c.coverage_score(lit(0.95), lit(0.1), lit(0.9))) == pytest.approx(0.5)
    assert v(c.ratio(lit(1), lit(0))) == 0 and v(c.to_uint8(lit(0.5))) == 128 and v(c.to_uint8(lit(1.0))) == 255 and v(c.to_uint8(lit(0.0))) == 0
    assert v(routing.hole_penalty(lit(1), lit(False))) == 0.35 and v(routing.hole_penalty(lit(27), lit(True))) == 0.5 and v(routing.hole_penalty(lit(3), lit(True))) == 0
    penalty, several = routing.component_penalty(lit(2), lit(0.5), lit(0.9))
    assert (v(penalty), v(several)) == (0.0, True)
    assert v(routing.component_penalty(lit(3), lit(0.1), lit(0.9))[0]) == 0.5
    assert v(routing.sharpness_score(lit(100), lit(10))) == 0 and v(routing.complexity_score(lit(400.0), lit(10000.0))) == 0
    assert v(c.contrast_curve(lit(0.5), lit(True))) == 0.5 and v(c.contrast_curve(lit(0.99), lit(False))) == 1 and v(c.contrast_curve(lit(0.01), lit(True))) == 0
    quad = [[10.0, 20.0], [90.0, 15.0], [95.0, 80.0], [5.0, 85.0]]
    h = np.array(v(c.homography(F.array(*[F.array(*map(lit, p)) for p in quad]))))
    for (x, y), want in zip([(0, 0), (1, 0), (1, 1), (0, 1)], quad, strict=True):
        p = h @ [x, y, 1]
        assert p[:2] / p[2] == pytest.approx(want)


def test_taxonomy_is_complete(spark):
    rows = taxonomy(spark).collect()
    assert [r.category for r in rows] == CATEGORIES and len(TAXONOMY) == 5
    assert all(0 < r.coverage_lo < r.coverage_hi <= 1 and r.fill_lo < r.fill_hi <= 1 and r.aspect_lo < r.aspect_hi for r in rows)


# --- text helpers


def test_text_helpers(spark):
    v = lambda col: value(spark, col)
    s = v(c.slug(F.lit(3), F.lit("https://cdn.example.com/a b/../weird name!.JPG")))
    assert s == "003_weird_name"
    assert v(c.slug(F.lit(1234), F.lit("///"), F.lit(""))) == "1234_image"
    assert v(c.category(F.lit("Phone Case"))) == "accessory" and v(c.category(F.lit("spaceship"))) == "auto" and v(c.category(F.lit(None).cast("string"))) == "auto"
    assert v(c.colour(F.lit("Light_Blue"))) == "light-blue" and v(c.colour(F.lit("LIGHTBLUE"))) == "light-blue" and v(c.colour(F.lit("red"))) == "red"
    data = F.lit("x" * 200).cast("binary")
    assert "\n" not in v(c.data_uri("image/png", data)) and bytes(v(c.decode_data_uri(c.data_uri("image/png", data)))) == b"x" * 200
    assert v(c.relative_url(F.lit("/artifacts/j/a.png"))) == "a.png" and v(c.relative_url(F.lit("data:x,/a"))) == "data:x,/a"
    assert v(c.is_safe_id(F.lit("a-b_c.1"))) and not v(c.is_safe_id(F.lit("../x"))) and not v(c.is_safe_id(F.lit("a\n")))
    assert v(c.safe_filename(F.lit("a b/ü.c"))) == "a_b_ü_c" and v(c.with_suffix(F.lit("a.png"), ".png")) == "a.png"
    assert v(c.html_escape(F.lit("<a href='x'>&"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;" and v(c.percent(F.lit(0.1234))) == "12.3%"


def test_settings_from_the_session(spark):
    spark.conf.set("assetloom.ready_threshold", "0.9")
    spark.conf.set("assetloom.max_side", "many")
    try:
        assert (Settings.of(spark).ready_threshold, Settings.of(spark).max_side) == (0.9, 6000)
    finally:
        spark.conf.unset("assetloom.ready_threshold")
        spark.conf.unset("assetloom.max_side")


# --- manifests


def items(found):
    good, bad = found
    return [(r.url, r.category, r.sku) for r in good.orderBy("row").collect()], [r.warning for r in bad.collect()]


@pytest.mark.parametrize(("text", "want", "warnings"), [
    ("sku,Image URL,product_type\nTEE-001,https://x/a.jpg,T-Shirt\nMUG-002,https://x/b.png,mug\nBAD-003,,canvas\n", [("https://x/a.jpg", "apparel", "TEE-001"), ("https://x/b.png", "drinkware", "MUG-002")], ["row 4: no image URL"]),
    ("https://x/1.jpg\nhttps://x/2.jpg\n", [("https://x/1.jpg", "auto", None), ("https://x/2.jpg", "auto", None)], 1),
    ("url;category\nhttps://x/1.jpg;wall_art\n", [("https://x/1.jpg", "wall_art", None)], []),
    ("﻿URL\thoodie\nhttps://x/1.jpg\tq\n", [("https://x/1.jpg", "auto", None)], []),
    ("  \n", [], ["CSV is empty"]),
    ("foo,bar\n1,2\n", [], 1),
])
def test_csv_manifests(spark, tmp_path, text, want, warnings):
    (tmp_path / "m.csv").write_text(text)
    got, said = items(manifests.read_manifest(spark, str(tmp_path / "m.csv")))
    assert got == want and (len(said) == warnings if isinstance(warnings, int) else said == warnings)


@pytest.mark.parametrize(("text", "want", "warnings"), [
    ('["https://x/a.jpg", "ftp://x"]', [("https://x/a.jpg", "auto", None)], ["item 1: not an http(s) address"]),
    ('{"items": [{"image_url": "https://x/a.jpg", "category": "hoodie"}]}', [("https://x/a.jpg", "apparel", None)], []),
    ('{"images": [{"src": "https://x/a.jpg"}, 7, {}]}', [("https://x/a.jpg", "auto", None)], 2),
    ('[{"url": "https://x/a.jpg", "category": "Phone Case", "SKU": 12}]', [("https://x/a.jpg", "accessory", "12")], []),
    ('{"Image-URL": " https://x/a.jpg ", "type": "spaceship"}', [("https://x/a.jpg", "auto", None)], []),
    ("{nope", [], ["not a JSON list or object"]),
    ("7", [], ["not a JSON list or object"]),
])
def test_json_manifests(spark, tmp_path, text, want, warnings):
    (tmp_path / "m.json").write_text(text)
    got, said = items(manifests.read_manifest(spark, str(tmp_path / "m.json")))
    assert got == want and (len(said) == warnings if isinstance(warnings, int) else said == warnings)


def test_manifest_kind_by_first_character(spark, tmp_path):
    (tmp_path / "m").write_text('  ["https://x/a.jpg"]')
    assert items(manifests.read_manifest(spark, str(tmp_path / "m")))[0] == [("https://x/a.jpg", "auto", None)]


def test_commented_csv_and_hints(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# a\n# b\ntitle,category\nOne,mug\n ,x\nTwo,\n")
    assert [r.title for r in manifests.read_commented_csv(spark, str(tmp_path / "s.csv")).collect()] == ["One", "Two"]
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    hints = spark.createDataFrame([("a", "mug"), ("b", " ")], "file string, category string")
    assert {r.file: r.category for r in manifests.with_hints(files, hints).collect()} == {"a": "drinkware", "b": "auto", "c": "auto"}


# --- images and pixels


def rgb_png(path, array):
    h, w, _ = array.shape
    path.write_bytes(sinks.png_of(w, h, 3, array.astype("u1").tobytes()))


def test_image_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    big = rng.integers(0, 256, (40, 50, 3))
    rgb_png(tmp_path / "a.png", big)
    rgb_png(tmp_path / "small.png", big[:16, :16])
    (tmp_path / "bad.png").write_bytes(b"not an image at all")
    (tmp_path / "notes.txt").write_text("x")
    assert [Path(r.path).name for r in images.list_images(spark, str(tmp_path)).collect()] == ["a.png", "bad.png", "small.png"]
    assert images.list_images(spark, str(tmp_path), limit=2).count() == 2
    found = {Path(r.image.origin).name: r.error for r in images.decode(spark, str(tmp_path)).collect() if r.image.origin.endswith(".png")}
    assert found == {"a.png": None, "small.png": "short edge below 32", "bad.png": "cannot decode"}
    one = images.decode(spark, str(tmp_path)).where("image.origin like '%/a.png'")
    px = {(r.y, r.x): (r.r, r.g, r.b) for r in pixels.from_images(one).collect()}
    assert px == {(y, x): tuple(int(v) for v in big[y, x]) for y in range(40) for x in range(50)}
    uploads = spark.createDataFrame([(bytearray(b"x" * 10),), (bytearray(b""),), (None,), (bytearray(b"x" * 30),)], "content binary")
    assert [r.error for r in images.upload_errors(uploads, Settings(max_upload_mb=20e-6)).collect()] == [None, "empty", "empty", "too large"]


def grid(spark, array, name="m", image=1):
    return spark.createDataFrame([(image, y, x, v) for y, row in enumerate(np.asarray(array).tolist()) for x, v in enumerate(row)], f"image int, y int, x int, {name} {'long' if np.asarray(array).dtype.kind in 'iub' else 'double'}")


def back(df, name, shape):
    out = np.zeros(shape)
    for r in df.select("y", "x", name).collect():
        out[r.y, r.x] = r[name]
    return out


def test_box_erode_dilate_and_guided_filter(spark):
    rng = np.random.default_rng(1)
    a, g = rng.random((7, 9)), rng.random((7, 9))

    def around(f, v, r=2):
        return np.array([[f(v[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]) for x in range(9)] for y in range(7)])

    px = grid(spark, a, "a").join(grid(spark, g, "g"), ["image", "y", "x"])
    assert back(pixels.box(px, "a", 2, "o"), "o", a.shape) == pytest.approx(around(np.mean, a))
    assert back(pixels.erode(px, "a", 2, "o"), "o", a.shape) == pytest.approx(around(np.min, a))
    mean = lambda v: around(np.mean, v)
    slope = (mean(g * a) - mean(g) * mean(a)) / (mean(g * g) - mean(g) ** 2 + 1e-4)
    want = mean(slope) * g + mean(mean(a) - slope * mean(g))
    assert back(pixels.guided_filter(px, "g", "a", 2, 1e-4, "o"), "o", a.shape) == pytest.approx(want)


def test_components_holes_and_filling(spark):
    m = np.zeros((20, 20), int)
    m[2:12, 2:12] = 1
    m[5:8, 5:8] = 0
    m[12, 12] = m[13, 13] = 1
    m[16:18, 2:4] = 1
    m[0, 19] = 1
    px = grid(spark, m)
    areas = sorted(r.area for r in pixels.component_areas(pixels.label(px, "m")).collect())
    assert areas == [1, 4, 93]
    assert [r.area for r in pixels.holes(px, "m").collect()] == [9]
    assert back(pixels.fill_small_holes(px, "m", 0.05), "filled", m.shape)[5:8, 5:8].all()
    assert not back(pixels.fill_small_holes(px, "m", 0.01), "filled", m.shape)[5:8, 5:8].any()
    assert pixels.significant_components(pixels.label(px, "m")).count() == 93


def test_shapes(spark):
    m = np.zeros((10, 10), int)
    m[2:8, 3:6] = 1
    assert pixels.largest_rectangle(grid(spark, m), "m").first().area == 18
    e = pixels.extents(grid(spark, m), "m").first()
    assert (e.x0, e.x1, e.y0, e.y1, e.fill, e.aspect) == (3, 5, 2, 7, 1.0, 0.5)
    assert pixels.extents(grid(spark, m * 0), "m").count() == 0
    r = pixels.longest_column_run(grid(spark, m), "m").first()
    assert (r.x0, r.x1) == (3, 5)
    assert back(pixels.outline(grid(spark, m), "m"), "edge", m.shape).sum() == 14
    full = grid(spark, np.ones((5, 5), int))
    assert pixels.border_contact(full, "m").first().contact == 1.0


def test_mask_agreement(spark):
    def of(x):
        return grid(spark, np.asarray(x, float), "alpha")

    zero, one = np.zeros((10, 10)), np.ones((10, 10))
    assert pixels.mask_overlap(of(zero), of(zero)).first().iou == 1.0 and pixels.mask_overlap(of(zero), of(one)).first().iou == 0.0
    a, b = np.zeros((30, 30), int), np.zeros((30, 30), int)
    a[6:24, 6:24] = 1
    b[6:24, 7:25] = 1
    got = pixels.mask_overlap(of(a), of(b)).first()
    assert 0.8 < got.iou < 1 and got.iou == pixels.mask_overlap(of(b), of(a)).first().iou
    both = grid(spark, a, "a").join(grid(spark, b, "b"), ["image", "y", "x"])
    assert pixels.boundary_f1(both, "a", "b", 1).first().boundary_f1 == 1.0
    assert pixels.boundary_f1(both.withColumn("b", F.lit(0).cast("long")), "a", "b", 1).first().boundary_f1 == 0.0


def test_edges_and_background(spark):
    m = np.zeros((40, 40), int)
    m[10:30, 10:30] = 1
    px = grid(spark, m).withColumns({"r": F.when(F.col("m") == 1, 60).otherwise(236), "g": F.when(F.col("m") == 1, 90).otherwise(236), "b": F.when(F.col("m") == 1, 200).otherwise(240), "grey": F.when(F.col("m") == 1, 90.0).otherwise(237.0)})
    assert pixels.edge_alignment(px, "grey", "m", 2).first().edge_alignment == 1.0
    assert pixels.edge_alignment(px.withColumn("grey", F.lit(1.0)), "grey", "m", 2).first().edge_alignment == 0.0
    assert pixels.background_consistency(px, "m", 3, 4).first().bg_consistency == 1.0
    white = spark.createDataFrame([(1, 0, 0, 255, 255, 255), (1, 0, 1, 255, 0, 0)], "image int, y int, x int, r int, g int, b int")
    rows = pixels.lab(white).orderBy("x").collect()
    assert (round(rows[0].L), round(rows[0].a), round(rows[0].b_)) == (100, 0, 0) and (round(rows[1].L), round(rows[1].a), round(rows[1].b_)) == (53, 80, 67)
    assert value(spark, F.lit(1)) == 1 and white.select(pixels.skin(white).alias("s")).collect()[0].s is False


def test_png_round_trip(spark, tmp_path):
    m = np.arange(12).reshape(3, 4) * 20
    png = bytes(sinks.encode_png(grid(spark, m, "v")).first().png)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (4, 3)
    at = png.index(b"IDAT")
    size = struct.unpack(">I", png[at - 4 : at])[0]
    lines = zlib.decompress(png[at + 4 : at + 4 + size])
    assert [list(lines[y * 5 + 1 : y * 5 + 5]) for y in range(3)] == m.tolist()


# --- reports, curation, streaming


def results(spark):
    rows = [
        (0, "a", "s/a", "ok", "READY", 0.9, "auto", "given", 1, 1, "x", {"total": 100.0}, None, None, "m.png", ["one", "two"], None),
        (1, "b", "s/b", "ok", "REVIEW", 0.6, None, None, None, None, None, {"total": 200.0}, None, None, None, [], None),
        (2, "c", "s/c", "error", "FAILED", 0.1, None, None, None, None, None, {"total": 300.0}, None, None, None, [], "boom, \"x\""),
        (3, "d", "s/d", "ok", "READY", 0.95, None, None, None, None, None, {"total": 100.0}, None, None, None, ["<b>"], None),
    ]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def test_summary_and_flat_results(spark, tmp_path):
    df = results(spark)
    s = reporting.summarise(df.withColumn("total_ms", F.col("timings_ms")["total"]), 1000).first()
    assert (s.total, s.automation_rate, s.touchless_rate, s.mean_latency_ms, s.throughput_img_per_min, s.errors) == (4, 0.5, 0.75, 175.0, 240.0, 1)
    none = reporting.summarise(df.limit(0).withColumn("total_ms", F.lit(0.0)), 0).first()
    assert (none.total, none.automation_rate, none.mean_confidence, none.throughput_img_per_min) == (0, 0.0, 0.0, 0.0)
    flat = reporting.flat_results(df)
    assert flat.columns == RESULT_COLUMNS and [r.id for r in flat.collect()] == ["a", "b", "c", "d"]
    assert flat.first().reasons == "one | two" and flat.collect()[1].category == ""
    sinks.write_results_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("id,source,status,verdict,confidence") and '"boom, ""x"""' in text
    assert [r.id for r in df.orderBy(*reporting.report_order()).collect()] == ["b", "c", "a", "d"]
    html = [r.html for r in sinks.report_rows(df).collect()]
    assert "&lt;b&gt;" in html[3] and "60.0%" in html[0]
    assert {r.file for r in sinks.export_files(df, ["_m.png"], ["_x.png"], ["a"]).collect()} == {"a_m.png", "a_x.png", "b_m.png", "c_m.png", "d_m.png"}


def test_names_and_duplicates(spark):
    paths = ["b1/light_blue-Front-model.jpg", "b1/LightBlue-back-model.jpg", "b2/1-Model-Mask.jpg", "b2/black&white-front-MODEL.jpeg"]
    got = [(r.base_code, r.color, r.side) for r in curation.image_names(spark.createDataFrame([(p,) for p in paths], "path string")).collect()]
    assert got == [("b1", "light-blue", "front"), ("b1", "light-blue", "back"), ("b2", None, None), ("b2", "black-white", "front")]


def one_by_one(groups, ratios=(0.7, 0.15, 0.15)):
    """The rule said plainly: each group in its turn goes where the largest share is missing."""
    total, held, out = sum(n for _, n in groups), [0, 0, 0], {}
    for name, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        k = max(range(3), key=lambda k: ((ratios[k] * total - held[k]) / max(ratios[k] * total, 1e-6), -k))
        out[name], held[k] = curation.SPLITS[k], held[k] + n
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(0, 500), st.lists(st.integers(0, 300), min_size=3, max_size=3), st.sampled_from([(0.7, 0.15, 0.15), (0.5, 0.5, 0.0), (1 / 3, 1 / 3, 1 / 3)]))
def test_groups_of_one_size_are_dealt_as_one_by_one(n, m, held, ratios):
    quota, want = [r * (sum(held) + n * m) for r in ratios], [0, 0, 0]
    for _ in range(m):
        want[max(range(3), key=lambda k: ((quota[k] - held[k] - want[k] * n) / max(quota[k], 1e-6), -k))] += 1
    assert curation._give(n, m, quota, held) == want


def test_group_split_of_many_equal_groups(spark):
    groups = [(f"g{i:03d}", 1 + i % 3) for i in range(150)] + [("big", 40)]
    rows = spark.createDataFrame([(g,) for g, n in groups for _ in range(n)], "grp string")
    assert {r.grp: r.split for r in curation.group_split(rows, "grp").collect()} == one_by_one(groups)
    assert curation.group_split(rows.limit(0), "grp").count() == 0


def test_decisions(spark):
    manifest = spark.createDataFrame([("a", "READY"), ("b", "REVIEW")], "id string, verdict string")
    decisions = spark.createDataFrame([("a", "accept", "ok"), ("z", "fix", "")], "id string, status string, note string")
    updated, unknown = curation.apply_decisions(manifest, decisions)
    assert sorted((r.id, r.review_status, r.label_final) for r in updated.collect()) == [("a", "accept", "labels/a.png"), ("b", "", "")]
    assert [r.id for r in unknown.collect()] == ["z"]
    again, _ = curation.apply_decisions(updated, spark.createDataFrame([("a", "reject", "no")], "id string, status string, note string"))
    assert {r.id: (r.review_status, r.label_final, r.verdict) for r in again.collect()}["a"] == ("reject", "", "READY")
    assert [r.id for r in curation.usable(again).collect()] == [] and curation.usable(again, True).count() == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(99, 98), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {98: 98, 99: 98}


def test_streaming_progress(spark, small, tmp_path):
    done = results(spark).select(F.lit("j").alias("job_id"), "status", "verdict", "confidence", F.col("timings_ms")["total"].alias("total_ms"))
    for k in (0, 1):
        done.repartition(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(done.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    r = progress.run_available(progress.live_summary(stream), ["job_id"], str(tmp_path / "c1")).first()
    assert (r.total, r.ready, r.errors, r.throughput_img_per_min) == (8, 4, 2, 0.0)
    events = spark.read.parquet(f"{small}/events.parquet")
    flow = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet*").parquet(small)
    windows = progress.run_available(progress.windowed_counts(flow, "ts"), ["window", "event_type"], str(tmp_path / "c2"))
    assert windows.agg(F.sum("n")).first()[0] == events.count()
    assert shared_dir(spark)


def test_late_rows_are_left_out_and_state_goes_on(spark, tmp_path):
    """A second run goes on with the first one's state; what comes after the watermark isn't counted."""
    import datetime as dt

    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    schema = "ts timestamp, event_type string"
    flow = lambda: progress.windowed_counts(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), "ts")
    spark.createDataFrame([(at(1), "a"), (at(1, 5), "a"), (at(9), "a")], schema).write.parquet(str(tmp_path / "in/0"))
    first = progress.run_available(flow(), ["window", "event_type"], str(tmp_path / "out"))
    assert sorted((r.window.start.day, r.n) for r in first.collect()) == [(1, 2), (9, 1)]
    spark.createDataFrame([(at(1), "a"), (at(9, 3), "a"), (at(10), "b")], schema).write.parquet(str(tmp_path / "in/1"))
    second = progress.run_available(flow(), ["window", "event_type"], str(tmp_path / "out"))
    assert sorted((r.window.start.day, r.n) for r in second.collect()) == [(1, 2), (9, 2), (10, 1)]


def test_streamed_history_forgets(spark, tmp_path):
    flow = lambda: progress.newest(spark.readStream.schema("k string, i long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), "k", "i", 2)
    for run, rows in enumerate([[("a", 1), ("a", 5), ("b", 2)], [("a", 3), ("b", 9), ("b", 4)]]):
        spark.createDataFrame(rows, "k string, i long").write.parquet(str(tmp_path / f"in/{run}"))
        got = {r.k: r.newest for r in progress.run_available(flow(), ["k"], str(tmp_path / "out")).collect()}
    assert got == {"a": [5, 3], "b": [9, 4]}


def test_ties_of_a_score_go_up(spark, tmp_path):
    from decimal import ROUND_HALF_UP, Decimal

    import duckdb

    from assetloom import catalog

    texts = ["a" * k + "." * (32 - k) for k in range(13, 33)]
    spark.createDataFrame([(i, t, "en", "s", 32) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    exact = {i: float((Decimal("0.08") + min(Decimal("0.75") * k / 32 - Decimal("0.3"), Decimal("0.3"))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for i, k in enumerate(range(13, 33))}
    assert {r.doc_id: r.confidence for r in catalog.QUERIES["verdict_routing"](spark, str(tmp_path)).collect()} == exact
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert {i: score for i, _, score in con.execute(catalog.ORACLE_SQL["verdict_routing"]).fetchall()} == exact
    for name in ("report_order", "cards_order"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall())


def test_grid_verdicts_at_a_solidity_of_a_half(spark, tmp_path):
    import duckdb

    from assetloom import catalog

    masks = [(i, [0.3 if x == "1" else -0.3 for x in f"{m:064b}"]) for i, m in ((11710, 0x18131BD49AD20C0A), (22971, 0x503E350BECCD56DA))]
    spark.createDataFrame(masks, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["grid_verdicts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL['grid_verdicts']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 2


def test_newest_of_many_and_odd_keys(spark, tmp_path):
    big = 2**53 + 1
    flow = lambda: progress.newest(spark.readStream.schema("k long, i long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), "k", "i", 2, buckets=1)
    for run, rows in enumerate([[(k, i) for k in (*range(50), big, None) for i in (k or 0, 5, 5)], [(None, 9), (big, 7), (3, None)]]):
        spark.createDataFrame(rows, "k long, i long").coalesce(1).write.parquet(str(tmp_path / f"in/{run}"))
        query = progress.run_available(flow(), ["k"], str(tmp_path / "out"))
    got = {r.k: r.newest for r in query.collect()}
    assert got == {k: sorted({k, 5}, reverse=True) for k in range(50)} | {big: [big, 7], None: [9, 5]}
    # A batch gives the keys that it changed, and no others.
    assert spark.read.parquet(str(tmp_path / "out/rows/1")).count() == 2


def test_summary_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    rows = spark.range(40).repartition(4).select((F.udf(counted, "double")(F.col("id").cast("double")) / 40).alias("iou"), "id")
    found = evaluation.accuracy_summary(rows, "iou", "id").first()
    assert (found.images, found.median_iou, found.p95_latency) == (40, pytest.approx(19.5 / 40), pytest.approx(37.05)) and made.value == 40


def test_links_that_lie_together_need_no_rounds(spark, monkeypatch):
    from assetloom.operators import components, regions

    rounds, plain = [], components._small_star
    monkeypatch.setattr(components, "_small_star", lambda edges: rounds.append(1) or plain(edges))
    snake = [(i, y, x, int(y % 2 == 0 or x == (7 if y % 4 == 1 else 0))) for i in range(5) for y in range(9) for x in range(8)]
    px = spark.createDataFrame(snake, "image long, y long, x long, m int")
    assert {tuple(r) for r in regions.run_areas(regions.labelled_runs(px, "m")).select("image", "area").collect()} == {(i, 44) for i in range(5)} and not rounds
    monkeypatch.setattr(regions, "BAND", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert regions.run_areas(regions.labelled_runs(px, "m")).count() == 5 and rounds
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_percentiles_of_hot_and_small_groups(spark):
    rows = [("hot", float(i % 7)) for i in range(300)] + [("one", 2.5), (None, 1.0), (None, 2.0), ("null", None)]
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in evaluation.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], {"p0": 0, "p50": 0.5, "p95": 0.95, "p100": 1}).collect()}
    for g in ("hot", "one", None):
        own = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx([np.percentile(own, q) for q in (0, 50, 95, 100)])
    assert "null" not in got


def test_manifests_with_equal_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("URL,url,category\nhttp://x/1,http://x/2,mug\nhttp://x/3,,mug\n")
    items, warnings = manifests.read_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.row, r.url, r.category) for r in items.collect()] == [(2, "http://x/2", "drinkware")] and [r.row for r in warnings.collect()] == [3]
    (tmp_path / "a.json").write_text('[{"url": "http://x/1", "URL": "http://x/2"}, {"URL": "http://x/3", "url": "http://x/4"}, {"Image URL": "http://x/5", "url": "http://x/6", "category": 3}, "http://x/7", {"no": 1}]')
    items, warnings = manifests.read_json(spark, str(tmp_path / "a.json"))
    assert [(r.row, r.url) for r in items.orderBy("row").collect()] == [(0, "http://x/2"), (1, "http://x/4"), (2, "http://x/5"), (3, "http://x/7")] and warnings.count() == 1


def squares(spark):
    """Two images: a red square on white with a grey shadow beside it, and one without a mask."""
    px = []
    for y in range(60):
        for x in range(60):
            inside = 15 <= y < 45 and 15 <= x < 40
            px.append(("a", y, x, *((200, 30, 30) if inside else (250, 250, 250)), 1.0 if inside else 0.0))
    return spark.createDataFrame(px, "image string, y int, x int, r int, g int, b int, alpha double")


def test_colours_on_both_sides_of_the_outline(spark):
    px = squares(spark).withColumn("m", (F.col("alpha") > 0.5).cast("int"))
    assert pixels.boundary_contrast(px, "m", 2).first().boundary_contrast == 1.0
    shifted = px.withColumn("m", ((F.col("y") >= 10) & (F.col("y") < 25) & (F.col("x") >= 20) & (F.col("x") < 35)).cast("int"))
    assert pixels.boundary_contrast(shifted, "m", 2).first().boundary_contrast < 0.6
    assert pixels.boundary_contrast(px.withColumn("m", F.lit(0)), "m", 2).first().boundary_contrast == 0.5


def test_shadows_are_suppressed(spark):
    shadow = (F.col("y") >= 20) & (F.col("y") < 45) & (F.col("x") >= 49)
    px = squares(spark).withColumn("alpha", F.when(shadow, 0.4).otherwise(F.col("alpha")))
    for c in "rgb":
        px = px.withColumn(c, F.when(shadow, 200).otherwise(F.col(c)))
    out = pixels.suppress_shadow(px, "alpha", least_shadow=250).cache()
    assert out.where("alpha = 0.4").count() == 0 and out.where("alpha = 1").count() == 30 * 25 and out.first().shadow_suppressed
    same = pixels.suppress_shadow(px, "alpha", least_shadow=5000)
    assert same.where("alpha = 0.4").count() == 25 * 11 and not same.first().shadow_suppressed


def test_low_pass_keeps_to_the_object(spark):
    px = squares(spark).withColumn("v", F.when(F.col("alpha") > 0, 0.25).otherwise(1.0))
    out = pixels.weighted_low_pass(px, "v", "alpha", 3, "low").where("alpha = 1").agg(F.min("low"), F.max("low")).first()
    assert out == (pytest.approx(0.25), pytest.approx(0.25))


def test_contours_of_known_shapes(spark):
    diamond = [("d", y, x) for y in range(7) for x in range(7) if abs(y - 3) + abs(x - 3) <= 3]
    square = [("s", y, x) for y in range(5) for x in range(9)]
    got = {r.image: r.contour for r in pixels.contour_length(spark.createDataFrame(diamond + square, "image string, y int, x int")).collect()}
    assert got == {"d": pytest.approx(12 * 2**0.5), "s": pytest.approx(24)}


def test_images_to_verdicts(spark, tmp_path):
    """Good, broken, too small and mask-less images in one run: a row for each, the bad ones in error."""
    from assetloom.operators import verdicts
    from assetloom.sources import images as image_source

    pixel = bytes(v for y in range(60) for x in range(60) for v in ((200, 30, 30) if 15 <= y < 45 and 15 <= x < 40 else (250, 250, 250)))
    (tmp_path / "good.png").write_bytes(sinks.png_of(60, 60, 3, pixel))
    (tmp_path / "other.png").write_bytes(sinks.png_of(60, 60, 3, pixel))
    (tmp_path / "tiny.png").write_bytes(sinks.png_of(8, 8, 3, bytes(8 * 8 * 3)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    decoded = image_source.decode(spark, str(tmp_path))
    names = [r[0] for r in decoded.select("image.origin").collect()]
    good = next(n for n in names if n.endswith("good.png"))
    masks = squares(spark).select(F.lit(good).alias("image"), "y", "x", "alpha")
    hints = spark.createDataFrame([(good, "mug")], "image string, category string")
    rows = {r.image.rsplit("/", 1)[1]: r for r in verdicts.assess_images(decoded, masks, hints).collect()}
    assert {k: (r.status, r.verdict, r.error) for k, r in rows.items() if k != "good.png"} == {"other.png": ("error", "FAILED", "no mask"), "tiny.png": ("error", "FAILED", "short edge below 32"), "broken.png": ("error", "FAILED", "cannot decode")}
    r = rows["good.png"]
    assert (r.status, r.category, r.error) == ("ok", "drinkware", None) and r.confidence > 0.9 and r.verdict == "READY"


def test_report_cards(spark):
    df = results(spark).withColumn("print_area", F.lit(None).cast(results(spark).schema["print_area"].dataType))
    rows = {r.id: (r.tag, [tuple(c) for c in r.chips]) for r in df.select("id", reporting.verdict_tag(F.col("verdict")).alias("tag"), reporting.metric_chips().alias("chips")).collect()}
    assert any(not chips for _, chips in rows.values()) and all(tag in ("READY", "REVIEW", "FAILED") for tag, _ in rows.values())
    assert all([n for n, _ in chips][:1] == ["confidence"] and chips[-1][0] == "latency" for _, chips in rows.values() if chips)
    meta = reporting.with_run_metadata(df, "m", 4).first()
    assert (meta.run_model, meta.run_workers, meta.run_ready_threshold) == ("m", 4, 0.82)


def test_repeated_and_unknown_decisions(spark):
    """One row an id, the last known decision; what is refused says why."""
    manifest = spark.createDataFrame([("a", "READY"), ("b", "REVIEW"), ("c", "READY")], "id string, verdict string")
    decisions = spark.createDataFrame([("a", "accept", "ok", 1), ("a", "reject", None, 2), ("a", "later", "?", 3), ("b", "nonsense", "", 1), ("b", None, "", 2), ("z", "fix", "", 1), (None, "fix", "", 1)], "id string, status string, note string, at int")
    updated, refused = curation.apply_decisions(manifest, decisions, "at")
    assert sorted((r.id, r.review_status, r.reviewer_note, r.label_final) for r in updated.collect()) == [("a", "reject", None, ""), ("b", "", "", ""), ("c", "", "", "")]
    assert sorted((str(r.id), str(r.status), r.reason) for r in refused.collect()) == [("None", "fix", "unknown id"), ("a", "later", "unknown status"), ("b", "None", "unknown status"), ("b", "nonsense", "unknown status"), ("z", "fix", "unknown id")]
    assert curation.apply_decisions(manifest, decisions.limit(0), "at")[0].count() == 3


def test_rows_of_several_lists_are_numbered_in_their_file(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4)):
        (tmp_path / f"{name}.csv").write_text("url,category\n" + "".join(f"http://{name}/{i},mug\n" for i in range(n)) + ",mug\n")
    items, warnings = manifests.read_csv(spark, str(tmp_path))
    assert sorted((r.row, r.url) for r in items.collect()) == sorted([(i + 2, f"http://a/{i}") for i in range(3)] + [(i + 2, f"http://b/{i}") for i in range(4)])
    assert sorted(r.warning for r in warnings.collect()) == ["row 5: no image URL", "row 6: no image URL"]


def png(path, colour, channels, rows, extra=b""):
    """A PNG of the given colour type; rows: bytes of each line."""
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]) // channels, len(rows), 8, colour, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b""))


def exif(value, order="<"):
    """A TIFF structure with one other entry and the orientation."""
    import struct

    entries = struct.pack(order + "HHIHH", 0x0100, 3, 1, 7, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, value, 0)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 2) + entries + b"\0\0\0\0"


def test_grey_and_transparent_images(spark, tmp_path):
    png(tmp_path / "grey.png", 0, 1, [bytes(range(y, y + 40)) for y in range(33)])
    png(tmp_path / "clear.png", 6, 4, [bytes(v for x in range(40) for v in (x, 2 * x, y, (0, 255, 100)[x % 3])) for y in range(33)])
    rows = images.decode(spark, str(tmp_path))
    assert [r.error for r in rows.collect()] == [None, None]
    px = {(r.image.rsplit("/", 1)[1], r.y, r.x): (r.r, r.g, r.b) for r in pixels.from_images(rows).collect()}
    assert len(px) == 2 * 33 * 40
    for y in range(33):
        for x in range(40):
            assert px["grey.png", y, x] == (y + x,) * 3
            a = (0, 255, 100)[x % 3]
            assert px["clear.png", y, x] == tuple(int((v * a + 128 * (255 - a)) / 255 + 0.5) for v in (x, 2 * x, y))


@pytest.mark.parametrize("order", "<>")
def test_images_are_turned_upright(spark, tmp_path, order):
    import struct
    import zlib

    stored = np.arange(33 * 40).reshape(33, 40) % 251
    upright = {1: stored, 2: stored[:, ::-1], 3: stored[::-1, ::-1], 4: stored[::-1], 5: stored.T, 6: np.rot90(stored, -1), 7: stored[::-1, ::-1].T, 8: np.rot90(stored)}
    for k in [*upright, 9]:
        data = exif(k, order)
        chunk = struct.pack(">I", len(data)) + b"eXIf" + data + struct.pack(">I", zlib.crc32(b"eXIf" + data))
        png(tmp_path / f"{k}.png", 2, 3, [bytes(np.repeat(r, 3).tolist()) for r in stored], chunk)
    rows = pixels.from_images(images.decode(spark, str(tmp_path))).collect()
    for k in [*upright, 9]:
        want = upright.get(k, stored)
        own = {(r.y, r.x): r.g for r in rows if r.image.endswith(f"/{k}.png")}
        assert own == {(y, x): int(v) for (y, x), v in np.ndenumerate(want)}


def test_orientation_of_headers(spark):
    jpeg = b"\xff\xd8\xff\xe1\x00\x40Exif\0\0"
    cases = [(jpeg + exif(6), 6), (jpeg + exif(8, ">"), 8), (exif(3), 3), (jpeg + exif(0), 1), (jpeg + b"II", 1), (b"", 1), (None, 1), (b"\xff" * 70000, 1), (b"II*\0\xff\xff\xff\xff", 1), (jpeg[:9], 1)]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, (c, _) in enumerate(cases)], "i int, content binary")
    assert {r.i: r.o for r in df.select("i", images.orientation(F.col("content")).alias("o")).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_percentiles_of_a_value_that_half_of_all_rows_share(spark):
    """The ranges hold pairs of group and value, so no task takes the rows of one value."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit("g").alias("g"))
    pairs = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    summed = evaluation.running_counts(pairs, ["g", "v"], "n", "through").withColumn("task", F.spark_partition_id())
    assert summed.agg(F.max("through")).first()[0] == 200_000
    ranged = pairs.repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.median("count")).first()
    assert ranged[0] < 3 * ranged[1]
    got = evaluation.percentiles(rows, "v", [], {"p25": 0.25, "p75": 0.75}).first()
    want = np.percentile([0.0 if i % 2 == 0 else float(i) for i in range(200_000)], [25, 75])
    assert (got.p25, got.p75) == pytest.approx(tuple(want))
