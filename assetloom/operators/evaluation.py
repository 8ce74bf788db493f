"""Accuracy summaries and rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.session import cut, stored


def accuracy_summary(rows: DataFrame, iou: str, latency: str) -> DataFrame:
    """One row: count, mean, median and least iou, shares of rows from four levels on, mean and p95 latency.

    Percentiles come from ranks, so no task holds all values. ``rows`` are made once.
    """
    rows = stored(rows.select(*dict.fromkeys((iou, latency))), "accuracy")
    at = [F.avg((F.col(iou) >= t).cast("double")).alias(f"iou_at_{round(100 * t)}") for t in (0.50, 0.75, 0.90, 0.95)]
    plain = rows.agg(F.count("*").alias("images"), F.avg(iou).alias("mean_iou"), F.min(iou).alias("min_iou"), F.avg(latency).alias("mean_latency"), *at)
    median = percentiles(rows, iou, [], {"median_iou": 0.5})
    p95 = percentiles(rows, latency, [], {"p95_latency": 0.95})
    # One row each.
    return plain.join(F.broadcast(median), how="left").join(F.broadcast(p95), how="left")


def by_verdict(rows: DataFrame) -> DataFrame:
    """Count, share, mean and least iou of each verdict that occurs."""
    total = F.sum("count").over(Window.partitionBy())  # over three rows
    out = rows.groupBy("verdict").agg(F.count("*").alias("count"), F.avg("iou").alias("mean_iou"), F.min("iou").alias("min_iou"))
    return out.withColumn("share", F.col("count") / total)


def by_category(rows: DataFrame) -> DataFrame:
    known = rows.where("category_true is not null and category_true <> ''")
    return known.groupBy("category_true").agg(F.count("*").alias("count"), F.avg("iou").alias("mean_iou"), F.avg((F.col("category_pred") == F.col("category_true")).cast("double")).alias("accuracy"))


def ordinal_ranks(rows: DataFrame, by: list[Column | str], name: str) -> DataFrame:
    """Adds the rank by ``by``, from 1, without sorting all rows in one task.

    Rows are ranged by ``by``, numbered inside their range and moved up by the rows of earlier ranges;
    the table of ranges has one row a partition.
    """
    keys = [f"rank_key_{i}" for i in range(len(by))]
    keyed = rows.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(by, keys, strict=True)])
    ranged = cut(keyed.repartitionByRange(*keys).withColumn("rank_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("rank_part").orderBy(*keys))
    counts = ranged.groupBy("rank_part").agg(F.count("*").alias("rank_n"))
    earlier = F.coalesce(F.sum("rank_n").over(Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("rank_part", earlier.alias("rank_earlier"))
    # A row a partition.
    ranked = ranged.withColumn("rank_inside", inside).join(F.broadcast(offsets), "rank_part")
    return ranked.withColumn(name, F.col("rank_inside") + F.col("rank_earlier")).drop("rank_part", "rank_inside", "rank_earlier", *keys)


def running_counts(rows: DataFrame, by: list[str], count: str, name: str) -> DataFrame:
    """Adds the sum of ``count`` over all rows up to this one by ``by``, whose values don't repeat, without sorting all
    rows in one task: ranges are summed up inside and moved on by the totals of earlier ones, a row a range."""
    ranged = cut(rows.repartitionByRange(*by).withColumn("run_part", F.spark_partition_id()))
    inside = F.sum(count).over(Window.partitionBy("run_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("run_n").over(Window.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = ranged.groupBy("run_part").agg(F.sum(count).alias("run_n")).select("run_part", F.coalesce(before, F.lit(0)).alias("run_earlier"))
    summed = ranged.withColumn("run_inside", inside).join(F.broadcast(earlier), "run_part")
    return summed.withColumn(name, F.col("run_inside") + F.col("run_earlier")).drop("run_part", "run_inside", "run_earlier")


def percentiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, a column for each of ``shares``): exact percentiles with linear interpolation, nulls left out.

    Rows are counted by group and value first, so a value that many rows share is one row, and a group
    that holds a third of all rows is as many rows as it has values. A percentile lies at two places of the order of
    all rows, in the pairs whose running counts take in those places.
    """
    groups = {f"pct_by_{i}": F.col(k) for i, k in enumerate(by)} or {"pct_by_0": F.lit(0)}
    pairs = rows.where(F.col(value).isNotNull()).groupBy(*[g.alias(k) for k, g in groups.items()], F.col(value).cast("double").alias("pct_value")).agg(F.count("*").alias("pct_count"))
    counted = cut(running_counts(pairs, [*groups, "pct_value"], "pct_count", "pct_through"))
    sizes = counted.groupBy(*groups).agg(F.min(F.col("pct_through") - F.col("pct_count")).alias("pct_first"), F.sum("pct_count").alias("pct_n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), ((F.col("pct_n") - 1) * F.lit(float(share))).alias("at")) for k, share in shares.items()])
    each = sizes.select(*groups, "pct_first", F.explode(wanted).alias("w")).select(*groups, F.col("w.name").alias("pct_name"), "pct_first", F.col("w.at").alias("pct_at"))
    ends = F.array(*[F.struct(f(F.col("pct_at")).cast("long").alias("place"), weight.alias("weight")) for f, weight in ((F.floor, 1 - (F.col("pct_at") - F.floor("pct_at"))), (F.ceil, F.col("pct_at") - F.floor("pct_at")))])
    picked = each.select(*[F.col(k).alias(f"at_{k}") for k in groups], "pct_name", "pct_first", F.explode(ends).alias("e"))
    picked = picked.withColumns({"pct_place": F.col("pct_first") + F.col("e.place") + 1, "pct_weight": F.col("e.weight")}).drop("e", "pct_first")
    near = (F.col("pct_place") > F.col("pct_through") - F.col("pct_count")) & (F.col("pct_place") <= F.col("pct_through"))
    for k in groups:
        near = near & F.col(f"at_{k}").eqNullSafe(F.col(k))
    of = lambda k: F.sum(F.when(F.col("pct_name") == k, F.col("pct_weight") * F.col("pct_value"))).alias(k)
    found = picked.join(counted, near).groupBy(*groups).agg(*map(of, shares))
    return found.select(*[F.col(g).alias(k) for g, k in zip(groups, by, strict=False)], *shares)


def rank_correlation(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Spearman's correlation with ordinal ranks, ties by ``key``; NaN below three rows."""
    ranked = ordinal_ranks(ordinal_ranks(rows.select(key, a, b), [a, key], "rank_a"), [b, key], "rank_b")
    return ranked.agg(F.when(F.count("*") < 3, float("nan")).otherwise(F.corr("rank_a", "rank_b")).alias("rank_correlation"), F.count("*").alias("n"))
