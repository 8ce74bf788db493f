"""More queries: full mask assessment, exports, names, options, sweeps, streams. Each has its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assetloom.functions import columns as c
from assetloom.operators import curation, pixels, reporting, routing
from assetloom.plans.pixels import PX, _events_stream, _px
from assetloom.plans.registry import query
from assetloom.plans.relational import ROUTED, routed
from assetloom.schema import CATEGORIES, CATEGORY_ALIASES, Settings
from assetloom.session import shared_dir, table
from assetloom.sources import manifests, sinks
from assetloom.streaming import progress

TERMS = ["edge_alignment", "sharpness", "topology", "border", "bg_consistency", "shape_prior", "boundary_contrast", "complexity"]
#: A component x, of about -0.6 to 0.6, read as a term: 0.8 + x within 0 and 1.
UNIT = "least(1.0, greatest(0.0, 0.8::double + embedding[{}]::double))"


def _signals(spark, sf_dir):
    e = lambda i: F.col("embedding")[i - 1].cast("double")
    cols = {t: c.clip(0.8 + e(i)) for i, t in enumerate(TERMS, 1)} | {
        "category": F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("vec_id") % 5 + 1).cast("int")),
        "coverage": c.clip(0.5 + e(9)), "iou": F.when(e(10) > 0, c.clip(0.8 + e(10))), "boundary_f1": c.clip(0.7 + e(11)),
        "component_penalty": c.clip(e(12)), "multi_instance": e(13) > 0, "hole_penalty": c.clip(e(14)), "border_contact": c.clip(e(15)) / 4, "shadow_suppressed": e(16) > 0,
    }
    return table(spark, sf_dir, "embeddings").withColumns(cols)


@query(f"""with t(category, lo, hi) as (values ('apparel', 0.10::double, 0.92::double), ('drinkware', 0.05, 0.75), ('wall_art', 0.08, 0.95), ('accessory', 0.04, 0.90), ('auto', 0.03, 0.96)),
e as (select vec_id, {', '.join(f"{UNIT.format(i)} {t}" for i, t in enumerate(TERMS, 1))}, ['apparel','drinkware','wall_art','accessory','auto'][vec_id % 5 + 1] category,
  least(1.0, greatest(0.0, 0.5::double + embedding[9]::double)) coverage, case when embedding[10] > 0 then {UNIT.format(10)} end iou, least(1.0, greatest(0.0, 0.7::double + embedding[11]::double)) f1,
  least(1.0, greatest(0.0, embedding[12]::double)) cp, embedding[13] > 0 multi, least(1.0, greatest(0.0, embedding[14]::double)) hp, least(1.0, greatest(0.0, embedding[15]::double)) / 4 bc, embedding[16] > 0 shadow from embeddings),
a as (select *, case when iou is not null then least(1.0, greatest(0.0, 0.72::double * iou + 0.28::double * f1)) end ens,
  case when coverage between lo and hi then 1.0 when coverage < lo then least(1.0, coverage / lo) else least(1.0, greatest(0.0, (1 - coverage) / (1 - hi))) end cov from e join t using (category)),
k as (select *, (0.2::double * edge_alignment + coalesce(0.2::double * ens, 0.0) + 0.14::double * boundary_contrast + 0.12::double * sharpness + 0.1::double * bg_consistency + 0.1::double * topology + 0.07::double * cov + 0.05::double * border + 0.02::double * shape_prior)
  / (0.8::double + case when ens is null then 0.0 else 0.2::double end) * (1 - 0.1::double * complexity) conf,
  coalesce(ens < 0.78::double, false) or cp > 0.2::double or boundary_contrast < 0.5 or bg_consistency < 0.55::double or shape_prior < 0.6::double or bc > 0.06::double veto,
  list_filter([case when edge_alignment < 0.45::double then 'outline_off_edges' end, case when sharpness < 0.55::double then 'soft_edge' end, case when ens < 0.78::double then 'second_model_disagrees' end, case when cp > 0.2::double then 'split_into_pieces' end,
   case when cp <= 0.2::double and multi then 'several_products' end, case when hp > 0.2::double then 'unexpected_holes' end, case when boundary_contrast < 0.5 then 'cuts_through_object' end, case when bg_consistency < 0.55::double then 'part_of_larger_object' end,
   case when shape_prior < 0.6::double then 'atypical_silhouette' end, case when cov < 0.7::double then 'unexpected_coverage' end, case when bc > 0.06::double then 'cropped_by_frame' end, case when complexity > 0.4::double then 'complex_outline' end,
   case when shadow then 'shadow_removed' end], lambda x: x is not null) r from a),
v as (select *, case when coverage < 0.004::double or coverage > 0.985::double then 'FAILED' when conf >= 0.82::double and not veto then 'READY' when conf >= 0.55::double then 'REVIEW' else 'FAILED' end verdict from k)
select vec_id, verdict, round(case when coverage < 0.004::double or coverage > 0.985::double then 0 else conf end, 4) confidence, array_to_string(case when coverage < 0.004::double then ['no_product'] when coverage > 0.985::double then ['covers_whole_frame']
  when verdict = 'FAILED' then list_concat(['below_floor'], r) when verdict = 'READY' and len(r) = 0 then ['clean'] else r end, ' | ') reasons from v""")
def mask_assessment(spark, sf_dir):
    found = routing.assess(_signals(spark, sf_dir), Settings())
    return found.select("vec_id", "verdict", "confidence", F.array_join("reasons", " | ").alias("reasons"))


@query(ROUTED + """select t.t threshold, count(*) filter (confidence >= t.t) ready, count(*) filter (confidence < t.t and confidence >= 0.55::double) review from routed, (values (0.7::double), (0.82), (0.9)) t(t) group by 1""")
def threshold_sweep(spark, sf_dir):
    """One row of results for each setting of an ablation."""
    return curation.threshold_sweep(routed(spark, sf_dir), [0.7, 0.82, 0.9], 0.55)


@query(ROUTED + "select lang, count(*) images, count(distinct source) bases, array_to_string(list_sort(list(distinct source)), ' ') sources, count(*) filter (verdict = 'READY') ready, round(count(*) filter (verdict = 'READY') / count(*)::double, 4) auto_accept_rate from routed group by lang")
def build_summary(spark, sf_dir):
    return curation.build_summary(routed(spark, sf_dir), ["lang"], "source")


@query("select cast(doc_id as varchar) || s.s file, cast(doc_id as varchar) id from documents, (values ('_mask.png', true), ('_overlay.png', true), ('_cutout.png', false)) s(s, base) where base or cast(doc_id as varchar) like '%7%'")
def export_files(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return sinks.export_files(ids, ["_mask.png", "_overlay.png"], ["_cutout.png"], ["7"])


@query("select split, 'images/' || doc_id || chr(9) || coalesce(case when doc_id % 3 = 0 then 'labels/' || doc_id end, 'auto/' || doc_id) line from (select doc_id, case when doc_id % 5 = 0 then 'test' else 'train' end split from documents)")
def split_lists(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("images/"), d).alias("image"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("labels/"), d)).otherwise(" ").alias("label_final"), F.concat(F.lit("auto/"), d).alias("label_auto"))
    return sinks.split_lists(rows)


NAMES = ["light_blue-Front-model.jpg", "LightBlue-back-model.jpeg", "1-Model-Mask.jpg", "black&white-front-MODEL.jpg", "Sea-Green-back-model.jpg"]


@query(f"""with f as (select doc_id, 'b' || (doc_id % 7) base_code, [{', '.join(map(repr, NAMES))}][doc_id % {len(NAMES)} + 1] f from documents),
s as (select *, regexp_replace(f, '\\.[^.]*$', '') stem from f), m as (select *, regexp_matches(stem, '(?i)^[A-Za-z][A-Za-z0-9&_-]*-(front|back)-model$') fits, replace(lower(regexp_extract(stem, '(?i)^([A-Za-z][A-Za-z0-9&_-]*)-(front|back)-model$', 1)), '_', '-') col from s)
select doc_id, base_code, case when fits then case replace(col, '-', '') when 'lightblue' then 'light-blue' when 'lightyellow' then 'light-yellow' when 'lightgreen' then 'light-green' when 'blackwhite' then 'black-white' when 'black&white' then 'black-white' else col end end color,
  case when fits then lower(regexp_extract(stem, '(?i)^([A-Za-z][A-Za-z0-9&_-]*)-(front|back)-model$', 2)) end side from m""")
def image_names(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x/b"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), name).alias("path"))
    return curation.image_names(paths).select("doc_id", "base_code", "color", "side")


@query("select page_id, left(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g'), 56) safe, regexp_extract(url, '[^/]*$') base, regexp_matches(url, '^[A-Za-z0-9._-]+$') safe_id, lower(url) similar to 'https?://.*' http from pages")
def name_checks(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", c.safe_filename(url).alias("safe"), c.relative_url(url).alias("base"), c.is_safe_id(url).alias("safe_id"), c.is_http(url).alias("http"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' stamp, printf('%.1f%%', floor(value) * 100.0) share from events")
def report_formats(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("stamp"), c.percent(F.floor("value").cast("double")).alias("share"))


@query("""select l_orderkey, l_linenumber, coalesce(case when l_linenumber % 3 = 0 then null else l_linenumber % 3 = 1 end, true) shadow,
  case when l_returnflag = 'N' then 'auto' else l_returnflag end category, l_linestatus = 'O' and l_returnflag in ('A', 'R') displacement from lineitem""")
def option_overrides(spark, sf_dir):
    """A request's option wins over the setting, an item's category over the request's, both must allow a layer."""
    option = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 3 == 1)
    item = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("auto")
    layer = curation.layer_wanted(F.col("l_linestatus") == "O", F.col("l_returnflag").isin("A", "R"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", curation.effective(option, F.lit(True)).alias("shadow"), curation.effective_category(item, F.lit(None).cast("string")).alias("category"), layer.alias("displacement"))


@query("select d.doc_id, case when l.doc_id is null then 'no ground truth' when n_chars < 20 then 'error' when quality is null then 'unreadable' when n_chars % 7 = 0 then 'resolution mismatch' end skip_reason from documents d left join labels l using (doc_id)")
def eval_skips(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("found", F.lit(True)), "doc_id", "left")
    why = curation.skip_reason(F.col("found"), F.col("n_chars") < 20, F.col("quality").isNotNull(), F.col("n_chars") % 7 != 0)
    return rows.select("doc_id", why.alias("skip_reason"))


@query("select round(sum(n_chars) / 1e6, 2) disk_mb from documents")
def disk_usage(spark, sf_dir):
    return reporting.disk_usage_mb(table(spark, sf_dir, "documents").withColumnRenamed("n_chars", "length"))


MODELS = [("large", 100, False), ("small", 50, True), ("classical", 1, True)]


@query("select name, row_number() over (order by (name = 'large')::int desc, priority desc) place from (values ('large', 100, false), ('small', 50, true), ('classical', 1, true)) m(name, priority, available) where available")
def model_order(spark, sf_dir):
    """Backends that are available: the preferred one first, then by priority."""
    rows = spark.createDataFrame(MODELS, "name string, priority int, available boolean").where("available")
    ranked = rows.select("name", F.struct((F.col("name") != "large").alias("other"), (-F.col("priority")).alias("p"), F.col("name").alias("name")).alias("k"))
    order = ranked.agg(F.array_sort(F.collect_list("k")).alias("ks")).select(F.posexplode("ks").alias("pos", "k"))
    return order.select("k.name", (F.col("pos") + 1).cast("long").alias("place"))


_ALIAS_ROWS = sorted((a, k) for k, others in CATEGORY_ALIASES.items() for a in others)


@query("select category, array_to_string(list_sort(list(alias)), ' ') aliases from (values " + ", ".join(f"('{a}', '{k}')" for a, k in _ALIAS_ROWS) + ") v(alias, category) group by category")
def taxonomy_aliases(spark, sf_dir):
    rows = spark.createDataFrame([(a,) for a, _ in _ALIAS_ROWS], "alias string").withColumn("category", c.category(F.col("alias")))
    return rows.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("alias")), " ").alias("aliases"))


def _mean(name: str, source: str, value: str, out: str) -> str:
    along = lambda v, line, at: f"avg({v}) over (partition by image, {line} order by {at} rows between 1 preceding and 1 following)"
    return f"{name}0 as (select *, {along(value, 'y', 'x')} {out}_ from {source}), {name} as (select *, {along(out + '_', 'x', 'y')} {out} from {name}0)"


@query(PX + ", q as (select image, y, x, e g, m::double v, e * e gg, e * m gv from px), " + ", ".join([_mean("a", "q", "g", "mg"), _mean("b", "a", "v", "mv"), _mean("c", "b", "gg", "mgg"), _mean("d", "c", "gv", "mgv")]) + """,
f as (select *, (mgv - mg * mv) / (mgg - mg * mg + 1e-4::double) s from d), h as (select *, mv - s * mg t from f), """ + ", ".join([_mean("i", "h", "s", "ms"), _mean("j", "i", "t", "mt")]) + " select image, y, x, round(ms * g + mt, 6) q from j")
def guided_filter(spark, sf_dir):
    return pixels.guided_filter(_px(spark, sf_dir), "e", "m", 1, 1e-4, "q").select("image", "y", "x", F.round("q", 6).alias("q"))


OUTLINE = "(select p.image, p.y, p.x, case when p.{m} = 1 and min(n.{m}) = 0 then 1 else 0 end e from {t} p join {t} n on n.image = p.image and abs(n.y - p.y) + abs(n.x - p.x) <= 1 group by p.image, p.y, p.x, p.{m})"


@query(PX + f"select image, y, x, e edge from {OUTLINE.format(m='m', t='px')}")
def outline(spark, sf_dir):
    return pixels.outline(_px(spark, sf_dir), "m").select("image", "y", "x", "edge")


@query(PX + f""", q as (select p.image, p.y, p.x, p.m a, n.m b from px p join px n on n.image = p.image + 1 and n.y = p.y and n.x = p.x), ea as {OUTLINE.format(m='a', t='q')}, eb as {OUTLINE.format(m='b', t='q')},
pa as (select p.image, p.y, p.x, p.e, max(n.e) near from ea p join eb n on n.image = p.image and abs(n.y - p.y) <= 1 and abs(n.x - p.x) <= 1 group by 1, 2, 3, 4), pb as (select p.image, p.y, p.x, p.e, max(n.e) near from eb p join ea n on n.image = p.image and abs(n.y - p.y) <= 1 and abs(n.x - p.x) <= 1 group by 1, 2, 3, 4),
s as (select image, sum(e)::double n, sum(e * near)::double h from pa group by 1), t as (select image, sum(e)::double n, sum(e * near)::double h from pb group by 1)
select s.image, round(case when s.n = 0 and t.n = 0 then 1 when s.n = 0 or t.n = 0 then 0 when s.h = 0 and t.h = 0 then 0 else 2 * (s.h / s.n) * (t.h / t.n) / (s.h / s.n + t.h / t.n) end, 9) boundary_f1 from s join t on s.image = t.image""")
def boundary_f1(spark, sf_dir):
    px = _px(spark, sf_dir)
    both = px.select("image", "y", "x", F.col("m").alias("a")).join(px.select((F.col("image") - 1).alias("image"), "y", "x", F.col("m").alias("b")), ["image", "y", "x"])
    return pixels.boundary_f1(both, "a", "b", 1).select("image", F.round("boundary_f1", 9).alias("boundary_f1"))


@query(PX + """, c as (select image, x, sum(m) n from px group by 1, 2), f as (select * from (select *, max(n) over (partition by image) top from c) where n > 0.5::double * top and top > 0),
r as (select *, sum(s) over (partition by image order by x rows unbounded preceding) run from (select *, case when x - lag(x) over (partition by image order by x) > 2 then 1 else 0 end s from f)),
g as (select image, run, min(x) x0, max(x) x1 from r group by 1, 2) select image, x0, x1 from (select *, row_number() over (partition by image order by x1 - x0 desc, x0) p from g) where p = 1""")
def longest_column_run(spark, sf_dir):
    return pixels.longest_column_run(_px(spark, sf_dir), "m", share=0.5)


@query("select cast(date_trunc('day', ts) as timestamp) as day, event_type, count(*) n from events group by 1, 2")
def windowed_events(spark, sf_dir):
    """Event-time windows of a day with a watermark, run to the end of the available data."""
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    found = progress.run_available(progress.windowed_counts(_events_stream(spark, sf_dir), "ts"), ["window", "event_type"], folder)
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("select o_custkey, array_to_string(list(o_orderkey order by o_orderkey desc), ' ') newest from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) place from orders) where place <= 3 group by 1")
def streamed_history(spark, sf_dir):
    """The newest three orders of each customer, kept as state of a stream that forgets what they push out."""
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders.parquet*").parquet(sf_dir)
    found = progress.run_available(progress.newest(orders, "o_custkey", "o_orderkey", 3), ["o_custkey"], f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    return found.select("o_custkey", F.array_join(F.col("newest").cast("array<string>"), " ").alias("newest"))


def _reviewed_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "reject").otherwise(" ").alias("review_status"))


@query("select w, count(*) n, cast(sum(doc_id) as bigint) ids from (select d.doc_id, case quality when 1 then 'accept' when 0 then 'reject' else 'todo' end s from documents d left join labels l using (doc_id)), (values ('all'), ('todo'), ('accept')) f(w) where w = 'all' or w = s group by w")
def review_filters(spark, sf_dir):
    rows, out = _reviewed_rows(spark, sf_dir), None
    for which in ("all", "todo", "accept"):
        found = curation.review_filter(rows, which).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(which).alias("w"), "n", "ids")
        out = found if out is None else out.union(found)
    return out


PATHS = ["a/b.png", "../b.png", "a/../../b", "a/../b", "/etc/x", "./a", "..", "a/./../b"]


@query(f"select doc_id, [true, false, false, true, false, true, false, true][doc_id % {len(PATHS)} + 1] inside from documents")
def contained_paths(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", c.stays_inside(path).alias("inside"))


@query("""with p as (select vec_id, unnest([{'x': embedding[1]::double, 'y': embedding[2]::double}, {'x': embedding[3]::double, 'y': embedding[4]::double}, {'x': embedding[5]::double, 'y': embedding[6]::double}, {'x': embedding[7]::double, 'y': embedding[8]::double}]) p from embeddings),
a as (select vec_id, p.x x, p.y y, atan2(p.y - avg(p.y) over w, p.x - avg(p.x) over w) t from p window w as (partition by vec_id)), o as (select *, row_number() over (partition by vec_id order by t) - 1 i, first_value(t) over (partition by vec_id order by x + y, t) t0 from a),
f as (select *, max(case when t = t0 then i end) over (partition by vec_id) i0 from o) select vec_id, (i - i0 + 4) % 4 place, round(x, 6) x, round(y, 6) y from f""")
def ordered_quads(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    quads = table(spark, sf_dir, "embeddings").select("vec_id", c.ordered_quad(F.array(*[F.array(e[2 * i], e[2 * i + 1]) for i in range(4)])).alias("quad"))
    return quads.select("vec_id", F.posexplode("quad").alias("place", "p")).select("vec_id", F.col("place").cast("long").alias("place"), F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


def _old_and_new(d):
    """An old and a new address of each document; one in three lacks the old, one in five the new."""
    old = F.when(d % 3 != 0, F.concat(F.lit("http://old/"), d.cast("string"))).otherwise("")
    new = F.when(d % 5 != 0, F.concat(F.lit("https://new/"), d.cast("string"), F.lit(".jpg"))).otherwise("")
    return old, new


LISTS = 8
MANIFEST_SQL = "select cast(doc_id as varchar) sku, 'https://new/' || doc_id || '.jpg' url, 'apparel' category from documents where doc_id % 5 <> 0"


@query(MANIFEST_SQL)
def csv_manifest(spark, sf_dir):
    """Written lists whose header has one name twice: the last column counts, rows without an address there are warnings.

    Each list is a file of its own, so they are written and read side by side.
    """
    d = F.col("doc_id")
    old, new = _old_and_new(d)
    folder = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "documents").select((d % LISTS).alias("list"), d.alias("k"), F.concat_ws(",", d.cast("string"), old, new, F.lit("T-Shirt")).alias("value"))
    heads = spark.range(LISTS).select("id", F.lit(-1).cast("long"), F.lit("SKU,URL,url,Product Type"))
    lines.union(heads).repartition("list").sortWithinPartitions("list", "k").drop("k").write.partitionBy("list").text(folder)
    return manifests.read_csv(spark, folder)[0].select("sku", "url", "category")


@query(MANIFEST_SQL)
def json_manifest(spark, sf_dir):
    """The same as one JSON document, with keys that normalise alike."""
    d = F.col("doc_id")
    old, new = _old_and_new(d)
    folder = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    entry = F.to_json(F.struct(d.cast("string").alias("sku"), old.alias("url"), new.alias("URL "), F.lit("hoodie").alias("type")))
    entries = table(spark, sf_dir, "documents").agg(F.concat(F.lit('{"items": ['), F.array_join(F.collect_list(entry), ","), F.lit("]}")).alias("value"))
    entries.write.text(folder)
    return manifests.read_json(spark, folder)[0].select("sku", "url", "category")
