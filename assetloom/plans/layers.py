"""Layers of light: every embedding is a picture of 8 x 8 whose alpha and colours are its components."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions.columns import clip
from assetloom.operators import layers
from assetloom.plans.pixels import PX, _px
from assetloom.plans.registry import query
from assetloom.session import cut

#: Colours, lightness and alpha of each pixel.
PICTURE = (
    PX
    + """, co as (select image, y, x, greatest(0, least(1, 0.9::double + 3 * e)) a, least(255, greatest(0, floor(128 + 200 * e))) r, least(255, greatest(0, floor(128 + 100 * e))) g, 128 b from px),
ch as (select *, 0.212671::double * case when r <= 10 then r / 255 / 12.92::double else pow((r / 255 + 0.055::double) / 1.055::double, 2.4::double) end
  + 0.715160::double * case when g <= 10 then g / 255 / 12.92::double else pow((g / 255 + 0.055::double) / 1.055::double, 2.4::double) end
  + 0.072169::double * pow((b / 255 + 0.055::double) / 1.055::double, 2.4::double) yy from co),
li as (select image, y, x, a, r, g, b, (116 * case when yy > 0.008856::double then cbrt(yy) else 7.787::double * yy + 16 / 116::double end - 16) / 100 l from ch),
en as (select image, sum(a) >= 8 ok from li group by 1)"""
)


def _near(p: str, q: str) -> str:
    """What two places on one axis, in cells, weigh for each other."""
    part = lambda v, up: f"({v} - floor({v}))" if up else f"(1 - {v} + floor({v}))"
    pairs = [f"{part(p, i)} * {part(q, j)} * (abs(floor({p}) + {i} - floor({q}) - {j}) <= 1)::int" for i in (0, 1) for j in (0, 1)]
    return f"({' + '.join(pairs)})"


def _means(rows: str, value: str, weight: str, space: float, spread: float | None = None) -> str:
    """A table's columns and the mean ``mean`` of ``value`` over all pairs of an image's pixels."""
    k = " * ".join([_near(f"(p.{c} / {space}::double)", f"(q.{c} / {space}::double)") for c in "yx"] + ([_near(f"(p.{value} / {spread}::double)", f"(q.{value} / {spread}::double)")] if spread else []))
    return f"(select p.*, q.mean from {rows} p join (select image, y, x, sum(k * w * v) / greatest(sum(k * w), {layers.LEAST_WEIGHT} * sum(k)) mean from (select p.image, p.y, p.x, q.{value} v, {weight} w, {k} k from {rows} p join {rows} q on q.image = p.image) group by 1, 2, 3) q on q.image = p.image and q.y = p.y and q.x = p.x)"


def _picture(spark, sf_dir):
    colour = lambda by: clip(F.floor(128 + by * F.col("e")).cast("double"), 0, 255)
    return cut(_px(spark, sf_dir).select("image", "y", "x", clip(0.9 + 3 * F.col("e")).alias("alpha"), colour(200).alias("r"), colour(100).alias("g"), F.lit(128.0).alias("b")))


@query(
    PICTURE
    + f""", sh as (select image, y, x, a, l / greatest(mean, 0.02::double) s from {_means('li', 'l', 'q.a', 6)}),
ra as (select image, y, x, a, greatest(0, least(1, 1 - mean)) shadow, greatest(0, least(1, mean - 1)) highlight from {_means('sh', 's', '1', 3 * layers.CUT_OFF, 0.08)}),
tp as (select image, quantile_cont(shadow, 0.99) ts, quantile_cont(highlight, 0.99) th from ra where a > 0.5::double group by 1)
select image, y, x, round(case when ok then least(1, shadow / case when ts > 1e-3 then ts else 1 end) * a else 0 end, 6) shadow,
  round(case when ok then least(1, highlight / case when th > 1e-3 then th else 1 end) * a else 0 end, 6) highlight from ra join en using (image) left join tp using (image)"""
)
def light_layers(spark, sf_dir):
    """What is darker and what is lighter than the object's own tone."""
    found = layers.light_layers(_picture(spark, sf_dir), "alpha", least=8)
    return found.select("image", "y", "x", F.round("shadow", 6).alias("shadow"), F.round("highlight", 6).alias("highlight"))


@query(
    PICTURE
    + f""", sm as (select image, y, x, a, mean s from {_means('li', 'l', '1', 3 * layers.CUT_OFF, 0.06)}),
re as (select image, y, x, a, s - mean d from {_means('sm', 's', 'q.a', 4)}),
tp as (select image, quantile_cont(abs(d), 0.98) t from re where a > 0.5::double group by 1)
select image, y, x, case when ok and a > 0.5::double then cast(floor(round(greatest(-1, least(1, d / greatest(t, 1e-3))) * a * 127 + 128.5::double, 9)) as int) else 128 end displacement from re join en using (image) left join tp using (image)"""
)
def displacement(spark, sf_dir):
    """Folds around neutral grey."""
    return layers.displacement(_picture(spark, sf_dir), "alpha", least=8).select("image", "y", "x", "displacement")


@query(
    PICTURE
    + """, ne as (select p.*, (a > 0.01::double and a < 0.85::double and exists (select 1 from li n where n.image = p.image and n.a > 0.85::double and abs(n.y - p.y) <= 2 and abs(n.x - p.x) <= 2)) need from li p),
go as (select image, count(*) filter (a > 0.85::double) > 8 and count(*) filter (need) > 2 ok from ne group by 1),
nr as (select p.image, p.y, p.x, min_by([n.r, n.g, n.b], ((n.y - p.y) * (n.y - p.y) + (n.x - p.x) * (n.x - p.x)) * 10000 + n.y * 100 + n.x) c from ne p join li n on n.image = p.image and n.a > 0.85::double where p.need group by 1, 2, 3)
select ne.image, ne.y, ne.x, cast(case when ok and need then c[1] else r end as int) cut_r, cast(case when ok and need then c[2] else g end as int) cut_g, cast(case when ok and need then c[3] else b end as int) cut_b,
  cast(floor(a * 255 + 0.5::double) as int) cut_a from ne join go using (image) left join nr on nr.image = ne.image and nr.y = ne.y and nr.x = ne.x"""
)
def cut_out(spark, sf_dir):
    """The object on nothing, its soft edge in the colours of the nearest solid pixels."""
    found = layers.cut_out(_picture(spark, sf_dir), "alpha", wide=2, least_core=8, least_edge=2)
    return found.select("image", "y", "x", "cut_r", "cut_g", "cut_b", "cut_a")
