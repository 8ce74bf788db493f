"""Pixel queries: every embedding is a grid of 8 x 8, its mask the positive components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from assetloom.operators import edges, pixels, printarea, routing, shapes, verdicts
from assetloom.plans.registry import query
from assetloom.schema import CATEGORIES, Settings
from assetloom.session import cut, shared_dir, table
from assetloom.streaming import progress

PX = """
with recursive px as (select vec_id image, cast(p // 8 as bigint) y, cast(p % 8 as bigint) x, cast(e as double) e, cast(e > 0 as bigint) m
  from (select vec_id, unnest(embedding) e, generate_subscripts(embedding, 1) - 1 p from embeddings))
"""


def _px(spark, sf_dir):
    grid = pixels.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return grid.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "e", (F.col("e") > 0).cast("long").alias("m"))


def _neighbourhood(how: str, value: str, r: int = 1) -> str:
    return f"(select {how}(n.{value}) from px n where n.image = p.image and abs(n.y - p.y) <= {r} and abs(n.x - p.x) <= {r})"


@query(PX + """, a as (select image, y, x, greatest(least(e + 0.5::double, 1), 0) v from px), b as (select p.image, p.v p, g.v g from a p join a g on g.image = p.image + 1 and g.y = p.y and g.x = p.x)
select image, round(case when count(*) filter (p > 0.5 or g > 0.5) = 0 then 1 else count(*) filter (p > 0.5 and g > 0.5) / cast(count(*) filter (p > 0.5 or g > 0.5) as double) end, 9) iou,
  round(2.0 * count(*) filter (p > 0.5 and g > 0.5) / greatest(1, count(*) filter (p > 0.5) + count(*) filter (g > 0.5)), 9) dice, round(avg(abs(p - g)), 9) mae, round(sum(abs(p - g)) / 1000.0, 9) sad_k from b group by image""")
def mask_overlap(spark, sf_dir):
    a = _px(spark, sf_dir).withColumn("alpha", F.greatest(F.least(F.col("e") + 0.5, F.lit(1.0)), F.lit(0.0)))
    return pixels.mask_overlap(a, a.withColumn("image", F.col("image") - 1)).select("image", *[F.round(x, 9).alias(x) for x in ("iou", "dice", "mae", "sad_k")])


@query(PX + "select image, round(avg(m), 9) coverage from px group by image")
def coverage(spark, sf_dir):
    return pixels.coverage(_px(spark, sf_dir), "m").select("image", F.round("coverage", 9).alias("coverage"))


@query(PX + ", s as (select image, sum(m * ((y = 0)::int + (y = 7)::int + (x = 0)::int + (x = 7)::int)) / 32.0::double c from px group by image) select image, round(c, 9) contact, round(least(1, greatest(0, 1 - (c - 0.02::double) / 0.28::double)), 9) border from s")
def border_contact(spark, sf_dir):
    return pixels.border_contact(_px(spark, sf_dir), "m").select("image", F.round("contact", 9).alias("contact"), F.round("border", 9).alias("border"))


@query(PX + f"select image, y, x, round({_neighbourhood('avg', 'e')}, 9) mean from px p")
def box_filter(spark, sf_dir):
    return pixels.box(_px(spark, sf_dir), "e", 1, "mean").select("image", "y", "x", F.round("mean", 9).alias("mean"))


@query(PX + f"select image, y, x, {_neighbourhood('min', 'm')} v from px p")
def erode(spark, sf_dir):
    return pixels.erode(_px(spark, sf_dir), "m", 1, "v").select("image", "y", "x", "v")


@query(PX + f"select image, y, x, {_neighbourhood('max', 'm')} v from px p")
def dilate(spark, sf_dir):
    return pixels.dilate(_px(spark, sf_dir), "m", 1, "v").select("image", "y", "x", "v")


@query(PX + ", q as (select image, y, x, (m > 0.92)::int fg, (m < 0.08)::int bg from px) select p.image, p.y, p.x, case when min(n.fg) = 1 then 255 when min(n.bg) = 1 then 0 else 128 end trimap from q p join q n on n.image = p.image and abs(n.y - p.y) <= 1 and abs(n.x - p.x) <= 1 group by 1, 2, 3")
def trimap(spark, sf_dir):
    return pixels.trimap(_px(spark, sf_dir), "m", 1).select("image", "y", "x", F.col("trimap"))


@query(PX + f"select image, y, x, {_neighbourhood('max', 'm')} > {_neighbourhood('min', 'm')} band from px p")
def boundary_band(spark, sf_dir):
    return pixels.boundary_band(_px(spark, sf_dir), "m", 3).select("image", "y", "x", "band")


@query(PX + """, b as (select y, x, min(y2) lo, max(y2) hi from (select 0 y, 0 x, 0 y2) group by 1, 2),
i as (select a.image, a.y y0, b.y y1, a.x x0, b.x x1 from (select image, y, x from px where m = 1) a join (select image, y, x from px where m = 1) b on a.image = b.image and b.y >= a.y and b.x >= a.x),
c as (select image, y, x, sum(sum(m)) over (partition by image, x order by y) s from px group by image, y, x),
t as (select image, y, x, cast(sum(s) over (partition by image, y order by x) as bigint) s from c),
r as (select i.image, (y1 - y0 + 1) * (x1 - x0 + 1) area, d.s - coalesce(u.s, 0) - coalesce(l.s, 0) + coalesce(k.s, 0) filled from i join t d on d.image = i.image and d.y = y1 and d.x = x1
  left join t u on u.image = i.image and u.y = y0 - 1 and u.x = x1 left join t l on l.image = i.image and l.y = y1 and l.x = x0 - 1 left join t k on k.image = i.image and k.y = y0 - 1 and k.x = x0 - 1)
select image, max(area) area from r where filled = area group by image""".replace(""", b as (select y, x, min(y2) lo, max(y2) hi from (select 0 y, 0 x, 0 y2) group by 1, 2),
i as""", ", i as"))
def largest_rectangle(spark, sf_dir):
    return pixels.largest_rectangle(_px(spark, sf_dir), "m").select("image", "area")


LABELS = ", own as (select image, y, x from px where m = {value}), l as (select image, y, x, y * 8 + x c from own union select o.image, o.y, o.x, l.c from l join own o on o.image = l.image and abs(o.y - l.y) <= 1 and abs(o.x - l.x) <= 1 {more}), best as (select image, y, x, min(c) c from l group by 1, 2, 3)"


@query(PX + LABELS.format(value=1, more="") + ", s as (select image, c, count(*) n from best group by 1, 2) select image, count(*) components, max(n) largest from s group by image")
def components(spark, sf_dir):
    areas = pixels.component_areas(pixels.label(_px(spark, sf_dir), "m"))
    return areas.groupBy("image").agg(F.count("*").alias("components"), F.max("area").alias("largest"))


@query(PX + LABELS.format(value=0, more="and abs(o.y - l.y) + abs(o.x - l.x) = 1") + ", s as (select image, c, count(*) n from best group by 1, 2 having min(y) > 0 and min(x) > 0 and max(y) < 7 and max(x) < 7) select image, count(*) holes, cast(sum(n) as bigint) area from s group by image")
def hole_count(spark, sf_dir):
    return pixels.holes(_px(spark, sf_dir), "m").groupBy("image").agg(F.count("*").alias("holes"), F.sum("area").alias("area"))


@query(PX + """, s as (select image, min(x) x0, max(x) x1, min(y) y0, max(y) y1, count(*) area from px where m = 1 group by image), f as (select *, area / ((x1 - x0 + 1) * (y1 - y0 + 1))::double fill, (x1 - x0 + 1) / (y1 - y0 + 1)::double aspect from s)
select image, round(fill, 9) fill, round(aspect, 9) aspect, round(least(1, greatest(0, case when fill < 0.62::double then 1 - (0.62::double - fill) / 0.3::double else 1 end)), 9) shape from f""")
def shape_bands(spark, sf_dir):
    found = pixels.shape_bands(pixels.extents(_px(spark, sf_dir), "m"), (0.62, 1.0), (0.1, 9.0))
    return found.select("image", *[F.round(x, 9).alias(x) for x in ("fill", "aspect", "shape")])


@query(PX + "select image, y // 2 y, x // 2 x, round(avg(e), 9) e from px group by 1, 2, 3")
def thumbnail(spark, sf_dir):
    return pixels.thumbnail(_px(spark, sf_dir), "e", 2).select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("e", 9).alias("e"))


@query(PX + "select image, k.y, k.x, e from px join (select a.k y, b.k x, a.k * 8 // 3 sy, b.k * 8 // 3 sx from (values (0), (1), (2)) a(k), (values (0), (1), (2)) b(k)) k on k.sy = px.y and k.sx = px.x")
def shrunk(spark, sf_dir):
    return pixels.shrink(_px(spark, sf_dir), most=3, least=2).select("image", "y", "x", "e")


_TURN = "abs((p.y - a.y) * (b.x - a.x) - (p.x - a.x) * (b.y - a.y)) / sqrt((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x))"


def _each(points: str, value: str) -> str:
    """A list of ``value`` for each corner p of a list, with its neighbours a and b, and i from 1."""
    n = f"len({points})"
    for k, at in (("a", f"(i + {n} - 2) % {n} + 1"), ("b", f"i % {n} + 1"), ("p", "i")):
        value = re.sub(rf"\b{k}\.", f"{points}[{at}].", value)
    return f"list_transform(range(1, {n} + 1), lambda i: {value})"


def _along(f: str) -> str:
    return f"list_transform(pts, lambda h: {f})"


#: From labels (best, best0) to hulls: fl has components with their holes, ex their rows' ends, hull the corners of the main one's.
HULLS = """,
ar as (select image, c, count(*) area, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from best group by 1, 2),
mn as (select * from (select *, row_number() over (partition by image order by area desc, c) p from ar) where p = 1),
hc as (select image, c from best0 group by 1, 2 having min(y) > 0 and min(x) > 0 and max(y) < 7 and max(x) < 7),
fl as (select image, c, y, x from best union all select h.image, o.c, h.y, h.x from best0 h join hc on hc.image = h.image and hc.c = h.c join best o on o.image = h.image and o.y = h.c // 8 and o.x = h.c % 8 - 1),
sq as (select image, c, sum(case n when 4 then 1.0::double when 3 then 0.5 else 0 end) outlined from (select image, c, y + dy qy, x + dx qx, count(*) n from fl, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx) group by 1, 2, 3, 4) group by 1, 2),
ex as (select image, c, y, min(x)::double l, max(x)::double r from fl group by 1, 2, 3),
wd as (select o.image, o.c, o.y, min(a.l + (b.l - a.l) * (o.y - a.y) / greatest(b.y - a.y, 1)) l, max(a.r + (b.r - a.r) * (o.y - a.y) / greatest(b.y - a.y, 1)) r
  from ex o join ex a on a.image = o.image and a.c = o.c and a.y <= o.y join ex b on b.image = o.image and b.c = o.c and b.y >= o.y group by 1, 2, 3),
hu as (select image, c, sum((w + coalesce(n, w)) / 2 * (n is not null)::int) around from (select image, c, r - l w, lead(r - l) over (partition by image, c order by y) n from wd) group by 1, 2),
so as (select image, c, case when around > 0 then coalesce(outlined, 0) / around else 0 end solidity from hu left join sq using (image, c)),
inner_ as (select o.image, o.y, bool_or(a.y is not null and b.y is not null and a.l + (b.l - a.l) * (o.y - a.y) / (b.y - a.y) <= o.l) l, bool_or(a.y is not null and b.y is not null and a.r + (b.r - a.r) * (o.y - a.y) / (b.y - a.y) >= o.r) r
  from ex o join mn on mn.image = o.image and mn.c = o.c left join ex a on a.image = o.image and a.c = o.c and a.y < o.y left join ex b on b.image = o.image and b.c = o.c and b.y > o.y group by 1, 2),
hv as (select ex.image, ex.y::double y, l x, ex.y k from ex join mn using (image, c) join (select image, y from inner_ where not l) v using (image, y) union all select ex.image, ex.y::double, r, 1000 - ex.y from ex join mn using (image, c) join (select image, y from inner_ where not r) v using (image, y)),
hull as (select image, list({'y': y, 'x': x} order by k) pts from (select image, y, x, min(k) k from hv group by 1, 2, 3) group by 1)"""
QUADS = f""",
dr as (select image, pts, 0.0::double cost from hull union all select image, list_filter(pts, lambda h, j: j <> list_position(flat, list_min(flat))), greatest(cost, list_min(flat)) from (select *, {_each('pts', _TURN)} flat from dr where len(pts) > 4)),
fo as (select dr.image, dr.pts, cost, list_min({_each('dr.pts', _TURN)}) next_, list_sum({_each('hull.pts', 'sqrt((b.y - p.y) * (b.y - p.y) + (b.x - p.x) * (b.x - p.x))')}) around from dr join hull using (image) where len(dr.pts) = 4),
qf as (select image, pts from fo where {' or '.join(f'(cost <= {t}::double * around and next_ > {t}::double * around)' for t in shapes.TOLERANCES)}),
di as (select image, pts, i, (b.y - a.y) / n uy, (b.x - a.x) / n ux from (select *, sqrt((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) n from (select image, pts, i, pts[i] a, pts[i % len(pts) + 1] b from (select image, pts, unnest(range(1, len(pts) + 1)) i from hull where len(pts) > 2)))),
rc as (select image, i, uy, ux, list_min(u) u0, list_max(u) u1, list_min(v) v0, list_max(v) v1 from (select *, {_along('h.y * uy + h.x * ux')} u, {_along('h.x * uy - h.y * ux')} v from di)),
qr as (select image, [{', '.join(f"{{'y': {u} * uy - {v} * ux, 'x': {u} * ux + {v} * uy}}" for u, v in (('u0', 'v0'), ('u1', 'v0'), ('u1', 'v1'), ('u0', 'v1')))}] pts from (select *, row_number() over (partition by image order by (u1 - u0) * (v1 - v0), i) p from rc) where p = 1),
qd as (select image, coalesce(qf.pts, qr.pts) pts, case when qf.pts is null then {shapes.RECTANGLE_WORTH}::double else 1 end worth from hull left join qf using (image) left join qr using (image) where coalesce(qf.pts, qr.pts) is not null),
qy as (select image, worth, pts, unnest(range(cast(ceil(list_min(list_transform(pts, lambda h: h.y)) - 1e-9) as bigint), cast(floor(list_max(list_transform(pts, lambda h: h.y)) + 1e-9) as bigint) + 1)) y from qd),
qe as (select image, y, pts[i] a, pts[i % 4 + 1] b from qy, (values (1), (2), (3), (4)) e(i)),
qx as (select image, y, unnest(case when abs(b.y - a.y) < 1e-9 then [a.x, b.x] else [a.x + (b.x - a.x) * (least(greatest(y::double, least(a.y, b.y)), greatest(a.y, b.y)) - a.y) / (b.y - a.y)] end) x from qe where least(a.y, b.y) <= y + 1e-9 and greatest(a.y, b.y) >= y - 1e-9),
qs as (select image, y, ceil(min(x) - 1e-9) s0, floor(max(x) + 1e-9) s1 from qx group by 1, 2),
qi as (select image, sum(s1 - s0 + 1) n from qs where s0 <= s1 group by 1),
qb as (select m.image, count(*) n from (select b.* from best b join mn on mn.image = b.image and mn.c = b.c) m join qs on qs.image = m.image and qs.y = m.y and m.x between s0 and s1 group by 1),
qq as (select mn.image, coalesce(worth, 0) * coalesce(qb.n, 0) / (mn.area + coalesce(qi.n, 0) - coalesce(qb.n, 0))::double quad_fit from mn left join qd on qd.image = mn.image left join qi on qi.image = mn.image left join qb on qb.image = mn.image),
ws as (select so.image, min(solidity) worst, max(case when so.c = mn.c then solidity end) solidity from so join ar on ar.image = so.image and ar.c = so.c join mn on mn.image = so.image where ar.area >= 0.05::double * mn.area group by 1)"""
BOTH_LABELS = LABELS.format(value=1, more="") + LABELS.format(value=0, more="and abs(o.y - l.y) + abs(o.x - l.x) = 1").replace(" own", " own0").replace(" l as", " l0 as").replace("from l join", "from l0 l join").replace("best as", "best0 as").replace("from l group", "from l0 group")


@query(PX + BOTH_LABELS + HULLS + QUADS + " select image, round(solidity, 6) solidity, round(worst, 6) worst_solidity, round(quad_fit, 6) quad_fit from ws join qq using (image)")
def silhouettes(spark, sf_dir):
    """How solid and how four-cornered the largest piece of each grid is."""
    found = pixels.topology(_px(spark, sf_dir), "m").where("pieces > 0")
    return found.select("image", *[F.round(c, 6).alias(c) for c in ("solidity", "worst_solidity", "quad_fit")])


@query(PX + BOTH_LABELS + HULLS + QUADS + """,
co as (select image, y, x, m, least(255, greatest(0, floor(128 + 200 * e))) r, least(255, greatest(0, floor(128 + 100 * e))) g, 128 b from px),
sk as (select *, greatest(r, g, b) v, least(r, g, b) lo, 0.299::double * r + 0.587::double * g + 0.114::double * b yy from co),
sn as (select *, case when v = 0 then 0 else (v - lo) / v end s, ((r - yy) * 0.713::double + 128 > 133 and (r - yy) * 0.713::double + 128 < 180 and (b - yy) * 0.564::double + 128 > 77 and (b - yy) * 0.564::double + 128 < 130) or (v < 62 and case when v = 0 then 0 else 255 * (v - lo) / v end < 110) skin from sk),
me as (select image, avg(s) filter (m = 1) sat, avg((v / 255 > 0.94::double)::int) filter (m = 1) spec from sn group by 1 having max(m) = 1),
nr as (select image, avg(skin::int) skin from sn p where exists (select 1 from px n where n.image = p.image and n.m = 1 and abs(n.y - p.y) <= 1 and abs(n.x - p.x) <= 1) group by 1),
ho as (select image, count(*) holes from hc group by 1),
f as (select mn.image, coalesce(holes, 0) holes, mn.area / ((x1 - x0 + 1) * (y1 - y0 + 1))::double fill, (x1 - x0 + 1) / (y1 - y0 + 1)::double aspect, quad_fit q, sat, spec, skin from mn join me using (image) join nr using (image) join qq using (image) left join ho using (image)),
sc as (select image, 1.4::double * least(1, skin / 0.10::double) + 0.9::double * greatest(0, (0.80::double - q) / 0.5::double) + case when holes >= 1 then 0.25::double else 0 end apparel,
  case holes when 1 then 1.3::double when 2 then 0.4 else 0 end + case when aspect between 0.6::double and 1.6::double then 0.5::double else 0 end + 0.9::double * greatest(0, (0.25::double - sat) / 0.25::double) + 0.8::double * least(1, spec / 0.06::double) + case when q > 0.55::double and q < 0.9::double then 0.4::double else 0 end drinkware,
  1.6::double * greatest(0, (q - 0.86::double) / 0.14::double) + greatest(0, (fill - 0.88::double) / 0.12::double) - case when holes > 0 then 0.8::double else 0 end wall_art,
  0.55::double + case when aspect between 0.35::double and 0.75::double and q > 0.8::double then 0.7::double else 0 end + case when aspect > 1.7::double and q > 0.9::double then 0.5::double else 0 end accessory from f),
ls as (select image, unnest(['apparel', 'drinkware', 'wall_art', 'accessory']) k, unnest([0, 1, 2, 3]) i, unnest([round(greatest(0, apparel), 9), round(greatest(0, drinkware), 9), round(greatest(0, wall_art), 9), round(greatest(0, accessory), 9)]) v from sc)
select s.image, round(round(apparel, 9), 6) apparel, round(round(drinkware, 9), 6) drinkware, round(round(greatest(0, wall_art), 9), 6) wall_art, round(round(accessory, 9), 6) accessory, (select k from ls where ls.image = s.image order by v desc, i limit 1) category from sc s""")
def category_scores(spark, sf_dir):
    """Each grid as a coloured picture: what its silhouette, holes, colours and skin say about its category."""
    colour = lambda by: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + by * F.col("e")).cast("double")))
    px = cut(_px(spark, sf_dir).withColumns({"r": colour(200), "g": colour(100), "b": F.lit(128.0)}))
    measured = pixels.topology(px, "m").join(printarea.category_measures(px, "m", 1), "image")
    scores = printarea.category_scores()
    best, _ = routing.category_choice(F.create_map(*[x for k in scores for x in (F.lit(k), F.col(k))]), list(scores))
    scored = measured.withColumns(scores)
    return scored.select("image", *[F.round(k, 6).alias(k) for k in scores], best.alias("category"))


BAND_SCORE = "greatest(0, least(1, case when {x} < {lo} then 1 - ({lo} - {x}) / {soft}::double when {x} > {hi} then 1 - ({x} - {hi}) / {soft}::double else 1 end))"
GRID_VERDICTS = (
    PX
    + BOTH_LABELS
    + HULLS
    + QUADS
    + f""",
pc as (select ar.image, count(*) pieces, min(ar.area) / max(ar.area)::double size_ratio from ar join mn on mn.image = ar.image where ar.area >= 0.05::double * mn.area group by 1),
ho as (select image, count(*) holes from hc group by 1),
main as (select b.image, b.y, b.x from best b join mn on mn.image = b.image and mn.c = b.c),
ed as (select * from main o where (select count(*) from main n where n.image = o.image and abs(n.y - o.y) + abs(n.x - o.x) = 1) < 4),
dg as (select a.image, count(*) d from ed a join ed b on b.image = a.image and b.y = a.y + 1 and abs(b.x - a.x) = 1 where not exists (select 1 from ed k where k.image = a.image and ((k.y = a.y + 1 and k.x = a.x) or (k.y = a.y and k.x = b.x))) group by 1),
ct as (select ed.image, count(*) + coalesce(max(d), 0) * (sqrt(2) - 1) contour from ed left join dg on dg.image = ed.image group by 1),
nb as (select p.image, p.y, p.x, p.m, p.e, max(n.m) hi, min(n.m) lo from px p join px n on n.image = p.image and abs(n.y - p.y) <= 1 and abs(n.x - p.x) <= 1 group by 1, 2, 3, 4, 5),
ew as (select image, avg(m) coverage, sum(case when hi > lo then 1 else 0 end)::double perimeter, count(*) filter (e + 0.5::double > 0.05::double and e + 0.5::double < 0.95::double) uncertain,
  sum(m * ((y = 0)::int + (y = 7)::int + (x = 0)::int + (x = 7)::int)) / 32.0::double contact from nb group by 1),
t(k, lo, hi, holes_ok, f0, f1, a0, a1) as (values (0, 0.10::double, 0.92::double, true, 0.34::double, 0.94::double, 0.45::double, 2.10::double), (1, 0.05, 0.75, true, 0.62, 1.0, 0.28, 1.9), (2, 0.08, 0.95, false, 0.78, 1.0, 0.25, 4.0), (3, 0.04, 0.9, true, 0.52, 1.0, 0.2, 4.5), (4, 0.03, 0.96, true, 0.25, 1.0, 0.15, 5.0)),
f as (select ew.*, coalesce(pieces, 0) pieces, coalesce(size_ratio, 1) size_ratio, coalesce(ho.holes, 0) holes, coalesce(mn.area, 0) main_area, mn.area / ((x1 - x0 + 1) * (y1 - y0 + 1))::double fill, (x1 - x0 + 1) / (y1 - y0 + 1)::double aspect, contour, coalesce(ws.solidity, 1) solidity, coalesce(ws.worst, 1) worst, qq.quad_fit, t.*
  from ew left join ws on ws.image = ew.image left join qq on qq.image = ew.image left join pc on pc.image = ew.image left join ho on ho.image = ew.image left join mn on mn.image = ew.image left join ct on ct.image = ew.image join t on t.k = ew.image % 5),
g as (select *, case when pieces = 0 then 1 when pieces between 2 and 4 and size_ratio >= 0.25 and round(worst, 9) >= 0.5::double then 0 else least(1, greatest(0, (pieces - 1) / 4.0::double)) end cp, case when f.holes > 12 then least(1, (f.holes - 12) / 30.0::double) when f.holes > 0 and not holes_ok then 0.35::double else 0 end hp,
  case when perimeter < 32 then 0 else greatest(0, least(1, 1 - (uncertain / perimeter - 2) / 12.0::double)) end sharp, case when main_area < 32 then 0 else greatest(0, least(1, (contour / sqrt(main_area) - 4.2::double) / 8.0::double)) end cx, greatest(0, least(1, 1 - (contact - 0.02::double) / 0.28::double)) border,
  case when coverage between lo and hi then 1 when coverage < lo then least(1, coverage / lo) else greatest(0, least(1, (1 - coverage) / (1 - hi))) end cov,
  case when main_area < 8 then 0 else least(case when round(solidity, 9) >= 0.93::double then 1 else {BAND_SCORE.format(x="fill", lo="f0", hi="f1", soft="0.30")} end, case when k = 2 then least(1, greatest(0, 1 - (0.95::double - quad_fit) / 0.25::double)) else 1 end, {BAND_SCORE.format(x="aspect", lo="a0", hi="a1", soft="1.20")}) end shape from f),
k as (select *, round((0.12::double * sharp + 0.10::double * case when pieces = 0 then 0 else greatest(0, 1 - 0.5::double * cp - 0.3::double * hp - 0.4::double * greatest(0, least(1, (0.62::double - solidity) / 0.4::double))) end + 0.07::double * cov + 0.05::double * border + 0.02::double * shape) / 0.36::double * (1 - 0.1::double * cx), 9) conf from g)
select image, pieces, holes, round(contour, 6) contour, cast(round(cast(case when coverage < 0.004::double or coverage > 0.985::double then 0 else conf end as decimal(18, 9)), 4) as double) confidence,
  case when coverage < 0.004::double or coverage > 0.985::double then 'FAILED' when conf >= 0.82::double and not (cp > 0.2::double or shape < 0.6::double or contact > 0.06::double) then 'READY' when conf >= 0.55::double then 'REVIEW' else 'FAILED' end verdict from k"""
)


@query(GRID_VERDICTS)
def grid_verdicts(spark, sf_dir):
    """From pixels to a verdict in one run: everything that a mask alone tells is measured, scored and routed."""
    px = _px(spark, sf_dir).withColumn("alpha", F.greatest(F.least(F.col("e") + 0.5, F.lit(1.0)), F.lit(0.0)))
    kind = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("image") % 5 + 1).cast("int"))
    measured = cut(verdicts.measure(px, "m", "alpha").withColumn("category", kind))
    found = routing.assess(verdicts.signals(measured, least=8), Settings())
    return found.select("image", "pieces", "holes", F.round("contour", 6).alias("contour"), "confidence", "verdict")


_KERNEL = edges.gaussian(1.0)
_MIRRORED = "case when {p} < 0 then -({p}) when {p} > 7 then 14 - ({p}) else {p} end"


@query(PX + f""", k(o, w) as (values {", ".join(f"({i - len(_KERNEL) // 2}, {w!r}::double)" for i, w in enumerate(_KERNEL))}),
a as (select p.image, p.y, p.x, sum(w * n.e) e from px p, k, px n where n.image = p.image and n.y = p.y and n.x = {_MIRRORED.format(p="p.x + o")} group by 1, 2, 3)
select p.image, p.y, p.x, round(sum(w * n.e), 9) smooth from a p, k, a n where n.image = p.image and n.x = p.x and n.y = {_MIRRORED.format(p="p.y + o")} group by 1, 2, 3""")
def smoothed(spark, sf_dir):
    return edges.convolve(_px(spark, sf_dir), "e", _KERNEL, "smooth").select("image", "y", "x", F.round("smooth", 9).alias("smooth"))


@query(PX + "select p.image, p.y, p.x, cast(min((n.y - p.y) * (n.y - p.y) + (n.x - p.x) * (n.x - p.x)) as bigint) squared from px p left join (select * from px where m = 1) n on n.image = p.image group by 1, 2, 3")
def mask_distances(spark, sf_dir):
    found = edges.squared_distances(_px(spark, sf_dir), "m")
    return found.select("image", "y", F.col("x").cast("long").alias("x"), "squared")


def _edges_sql(name: str, source: str) -> str:
    """Edge pixels of the table ``source`` (image, y, x, m) as the table ``name``, by neighbours and a search."""
    return f""",
{name}_g as (select p.image, p.y, p.x, 255.0::double * sum(n.m * dx * (2 - abs(dy))) gx, 255.0::double * sum(n.m * dy * (2 - abs(dx))) gy from {source} p, (values (-1), (0), (1)) a(dy), (values (-1), (0), (1)) b(dx), {source} n
  where n.image = p.image and n.y = least(7, greatest(0, p.y + dy)) and n.x = least(7, greatest(0, p.x + dx)) group by 1, 2, 3),
{name}_m as (select *, abs(gx) + abs(gy) m, case when abs(gy) <= {edges._LEVEL}::double * abs(gx) then 1 when abs(gy) >= {edges._UPRIGHT}::double * abs(gx) then 2 when gx * gy >= 0 then 3 else 4 end k from {name}_g),
{name}_t as (select p.image, p.y, p.x, p.m, p.k, coalesce(a.m, 0) am, coalesce(b.m, 0) bm from {name}_m p
  left join {name}_m a on a.image = p.image and a.y = p.y - (p.k > 1)::int and a.x = p.x + case p.k when 1 then -1 when 3 then -1 when 4 then 1 else 0 end
  left join {name}_m b on b.image = p.image and b.y = p.y + (p.k > 1)::int and b.x = p.x + case p.k when 1 then 1 when 3 then 1 when 4 then -1 else 0 end),
{name}_n as (select image, y, x, m from {name}_t where m > {edges.LOW} and m > am and (m > bm or (m = bm and k <= 2))),
{name} as (select image, y, x from {name}_n where m > {edges.HIGH} union select o.image, o.y, o.x from {name} l join {name}_n o on o.image = l.image and abs(o.y - l.y) <= 1 and abs(o.x - l.x) <= 1)"""


@query(PX + ", sb as (select image - 1 image, y, x, m from px), sa as (select px.* from px semi join sb using (image))" + _edges_sql("ea", "sa") + _edges_sql("eb", "sb") + """,
ha as (select image, count(*) n, count(*) filter (exists (select 1 from eb where eb.image = ea.image and (eb.y - ea.y) * (eb.y - ea.y) + (eb.x - ea.x) * (eb.x - ea.x) <= 2)) h from ea group by 1),
hb as (select image, count(*) n, count(*) filter (exists (select 1 from ea where ea.image = eb.image and (eb.y - ea.y) * (eb.y - ea.y) + (eb.x - ea.x) * (eb.x - ea.x) <= 2)) h from eb group by 1),
r as (select i.image, coalesce(ha.n, 0) a, coalesce(hb.n, 0) b, coalesce(ha.h, 0) / greatest(ha.n, 1)::double p, coalesce(hb.h, 0) / greatest(hb.n, 1)::double r from (select distinct image from sa) i left join ha on ha.image = i.image left join hb on hb.image = i.image)
select image, round(case when a = 0 and b = 0 then 1 when a = 0 or b = 0 or p + r = 0 then 0 else 2 * p * r / (p + r) end, 9) edge_f1 from r""")
def edge_f1(spark, sf_dir):
    """Each grid's mask against the next one's, by their edges within a circle of radius 1.5."""
    px = _px(spark, sf_dir).select("image", "y", "x", "m")
    both = px.join(px.select((F.col("image") - 1).alias("image"), "y", "x", F.col("m").alias("other")), ["image", "y", "x"])
    return edges.edge_f1(both, "m", "other", 1.5).select("image", F.round("edge_f1", 9).alias("edge_f1"))


def _events_stream(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)


@query("select event_type, count(*) n, round(sum(value), 4) total from events group by event_type")
def job_progress(spark, sf_dir):
    """The streaming count of what has arrived, run to the end of the available data."""
    counted = progress.progress_counts(_events_stream(spark, sf_dir), ["event_type"])
    return progress.run_available(counted, ["event_type"], f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}").withColumn("total", F.round("total", 4))
