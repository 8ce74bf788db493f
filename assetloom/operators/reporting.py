"""Batch summaries, report order, flat results, job history and stage timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.columns import percent, ratio
from assetloom.operators.evaluation import percentiles
from assetloom.schema import FAILED, READY, RESULT_COLUMNS, REVIEW, Settings


def summary_columns(wall_ms: Column) -> list[Column]:
    """Aggregates over results: verdict, status, confidence and total_ms (null where untimed)."""
    total, n = F.count("*"), lambda v: F.count_if(F.col("verdict") == v)
    return [
        total.alias("total"), n(READY).alias("ready"), n(REVIEW).alias("review"), n(FAILED).alias("failed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.round(ratio(n(READY), total), 4).alias("automation_rate"),
        F.round(ratio(n(READY) + n(REVIEW), total), 4).alias("touchless_rate"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("mean_confidence"),
        F.round(F.coalesce(F.avg("total_ms"), F.lit(0.0)), 2).alias("mean_latency_ms"),
        F.round(wall_ms, 2).alias("total_wall_ms"),
        F.round(F.when(wall_ms > 0, ratio(total, wall_ms / 60000.0)).otherwise(0.0), 2).alias("throughput_img_per_min"),
    ]


def summarise(results: DataFrame, wall_ms: float, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group. Rows in error count as failed and as errors."""
    return results.groupBy(*(by or [])).agg(*summary_columns(F.lit(float(wall_ms))))


def verdict_rank(verdict: Column, missing: int = 1) -> Column:
    """Review first, then failed, then ready; ``missing`` is the place of a null."""
    return F.when(verdict == REVIEW, 0).when(verdict == FAILED, 1).when(verdict == READY, 2).when(verdict.isNull(), missing).otherwise(3)


def report_order(best_first: bool = False, missing: int = 1) -> list[Column]:
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    return [verdict_rank(F.col("verdict"), missing), conf.desc() if best_first else conf.asc()]


def metric_chips() -> Column:
    """What a report card says about a row of RESULT_SCHEMA: (name, text) pairs; none for a row in error."""
    m = lambda name: F.col(f"metrics.{name}")
    fixed = lambda c, places: F.format_string(f"%.{places}f", c.cast("double"))
    chips = [
        ("confidence", fixed(F.coalesce("confidence", F.lit(0.0)), 3)),
        ("coverage", percent(m("coverage"))),
        ("edge", fixed(m("edge_sharpness"), 2)),
        ("ensemble IoU", F.when(m("ensemble_iou").isNotNull(), fixed(m("ensemble_iou"), 3))),
        ("solidity", fixed(m("solidity"), 2)),
        ("holes", m("holes").cast("string")),
        ("print area", F.when(F.col("print_area.kind") != "none", F.concat(F.col("print_area.kind"), F.lit(" ("), fixed(F.col("print_area.confidence"), 2), F.lit(")")))),
        ("latency", F.concat(fixed(F.coalesce(F.try_element_at("timings_ms", F.lit("total")), F.lit(0.0)), 0), F.lit(" ms"))),
    ]
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("text")) for k, v in chips]), lambda c: c["text"].isNotNull())
    return F.when((F.col("status") == "error") | F.col("metrics").isNull(), F.array().cast("array<struct<name:string,text:string>>")).otherwise(pairs)


def verdict_tag(verdict: Column) -> Column:
    """The verdict that a card shows: a row without one counts as failed."""
    return F.coalesce(verdict, F.lit(FAILED))


def with_run_metadata(results: DataFrame, model: str, workers: int, settings: Settings | None = None) -> DataFrame:
    """Adds the run's model, workers and thresholds to every row of a report."""
    s = settings or Settings.of(results.sparkSession)
    return results.withColumns({"run_model": F.lit(model), "run_workers": F.lit(workers), "run_ready_threshold": F.lit(s.ready_threshold), "run_review_threshold": F.lit(s.review_threshold)})


def filter_verdict(results: DataFrame, verdict: str) -> DataFrame:
    return results if verdict == "ALL" else results.where(F.col("verdict") == verdict)


def flat_results(results: DataFrame) -> DataFrame:
    """Rows of RESULT_SCHEMA as text columns for a sheet, nulls as empty text, in input order."""
    m, text = lambda name: F.col(f"metrics.{name}"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    of = {n: F.col(n) for n in ("id", "source", "status", "verdict", "confidence", "category", "category_source", "width", "height", "model", "mask_file", "error")}
    of |= {"total_ms": F.try_element_at("timings_ms", F.lit("total")), "reasons": F.array_join("reasons", " | "), "print_area_kind": F.col("print_area.kind"), "print_area_confidence": F.col("print_area.confidence")}
    of |= {n: m(n) for n in ("coverage", "edge_sharpness", "ensemble_iou", "holes", "solidity", "border_contact")}
    return results.orderBy("idx").select(*[text(of[n]).alias(n) for n in RESULT_COLUMNS])


def recent(jobs: DataFrame, sequence: str, limit: int, by: list[str] | None = None) -> DataFrame:
    """The ``limit`` newest rows, newest first; with ``by`` the newest of each group."""
    if not by:
        return jobs.orderBy(F.desc(sequence)).limit(limit)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(sequence)))
    return jobs.withColumn("place", place).where(F.col("place") <= limit)


def expired(files: DataFrame, now: Column, hours: float) -> DataFrame:
    """Files older than the retention; none if it is zero or less."""
    return files.where(F.lit(hours > 0) & (F.col("modificationTime") < now - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(hours % 1 * 60)))))


def disk_usage_mb(files: DataFrame) -> DataFrame:
    return files.agg(F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1e6, 2).alias("disk_mb"))


def stage_deltas(marks: DataFrame, image: str, mark: str, order: tuple[str, ...]) -> DataFrame:
    """Time of each stage: its mark less the mark before; null for the first."""
    before = F.lag(mark).over(Window.partitionBy(image).orderBy(*order))
    return marks.withColumn("delta", F.col(mark) - before)


def shares(df: DataFrame, value: str) -> DataFrame:
    """Each row's share of the sum, for a table of few aggregated rows."""
    total = df.agg(F.sum(value).alias("of_total"))
    # One row.
    return df.join(F.broadcast(total)).withColumn("share", ratio(F.col(value), F.col("of_total"))).drop("of_total")


def latency_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, exact p50 and p95, least and most of each group."""
    v = F.col(value)
    plain = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    ranked = percentiles(df, value, by, {"p50": 0.5, "p95": 0.95})
    same = [plain[c].eqNullSafe(ranked[c]) for c in by]
    return plain.join(ranked, same, "left").select(*[plain[c] for c in by], "n", "mean", "p50", "p95", "min", "max")


def runs(df: DataFrame, key: str, at: str, gap, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """Numbers the runs of each key from 0: a new one starts where ``at`` steps by more than ``gap``."""
    w = Window.partitionBy(key).orderBy(at, *tiebreak)
    starts = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")
