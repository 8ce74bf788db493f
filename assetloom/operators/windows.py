"""Square neighbourhoods of pixels in time that doesn't grow with the radius.

A square is a line across and a line down. Along a line a mean is the difference of two running sums. A least or
largest value comes from blocks as long as the window: a window lies in two neighbouring blocks at
most, so it is the end of one and the beginning of the next, whose extremes are running ones. Only
small windows are Spark's sliding frames, which look at each of their rows anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = (("y", "x"), ("x", "y"))
#: Up to this radius a sliding frame is cheaper than the extra sorts and columns.
NEAR = 4


def line_window(line: str, along: str):
    return Window.partitionBy("image", line).orderBy(along)


def means(px: DataFrame, values: dict[str, Column], radius: int) -> DataFrame:
    """Adds the means of several values, none of them null, over the square; pixels outside the image don't count.

    Rows and columns of an image have equal lengths, so the mean of means is the square's mean.
    """
    df = px.withColumns({k: v.cast("double") for k, v in values.items()})
    for line, along in AXES:
        w = line_window(line, along)
        if radius <= NEAR:
            df = df.withColumns({k: F.avg(k).over(w.rowsBetween(-radius, radius)) for k in values})
            continue
        through, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sums = {f"mean_sum_{i}": F.sum(k).over(through) for i, k in enumerate(values)} | {f"mean_all_{i}": F.sum(k).over(whole) for i, k in enumerate(values)}
        df = df.withColumns(sums | {"mean_at": F.row_number().over(w), "mean_n": F.count("*").over(whole)})
        n = F.least(F.col("mean_at") + radius, "mean_n") - F.greatest(F.col("mean_at") - radius - 1, F.lit(0))
        far = lambda i: F.coalesce(F.lead(f"mean_sum_{i}", radius).over(w), f"mean_all_{i}")  # noqa: E731, B023
        near = lambda i: F.coalesce(F.lag(f"mean_sum_{i}", radius + 1).over(w), F.lit(0.0))  # noqa: E731, B023
        df = df.withColumns({k: (far(i) - near(i)) / n for i, k in enumerate(values)}).drop(*sums, "mean_at", "mean_n")
    return df


def _line_extremes(df: DataFrame, outs: dict[str, tuple[str, Callable]], radius: int, line: str, along: str) -> DataFrame:
    """Adds, for each name, the least or largest (F.min or F.max) of a column over the line's window."""
    w = line_window(line, along)
    if radius <= NEAR:
        return df.withColumns({k: how(v).over(w.rowsBetween(-radius, radius)) for k, (v, how) in outs.items()})
    length, back = 2 * radius + 1, Window.partitionBy("image", line).orderBy(F.col(along).desc())
    df = df.withColumns({"ext_at": F.row_number().over(w) - 1, "ext_n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    df = df.withColumn("ext_block", F.floor(F.col("ext_at") / length))
    # The largest pair of block and value so far is the block at hand with its largest value so far. Least values are
    # largest negative ones. The way back gives the blocks' ends; the rows stay in that order for the rest.
    sign = {k: -1 if how is F.min else 1 for k, (_, how) in outs.items()}
    ways = {"begin": (w, F.col("ext_block")), "end": (back, -F.col("ext_block"))}
    for way, (frame, block) in ways.items():
        pairs = {f"ext_{way}_{i}": F.max(F.struct(block, sign[k] * F.col(v))).over(frame.rowsBetween(Window.unboundedPreceding, 0))["col2"] for i, (k, (v, _)) in enumerate(outs.items())}
        df = df.withColumns(pairs)
    inside = F.col("ext_at") + radius < F.col("ext_n")
    last = F.floor((F.col("ext_at") - radius) / length) == F.floor((F.col("ext_n") - 1) / length)
    found = {}
    for i, k in enumerate(outs):
        # The window begins in one block's end and ends in the same or the next one's begin, or where the line ends.
        begin = F.when(inside, F.lag(f"ext_begin_{i}", radius).over(back)).when(~last, F.first(f"ext_begin_{i}").over(back))
        found[k] = F.greatest(F.lead(f"ext_end_{i}", radius).over(back), begin) * sign[k]
    return df.withColumns(found).drop("ext_at", "ext_n", "ext_block", *[f"ext_{way}_{i}" for way in ways for i in range(len(outs))])


def extremes(px: DataFrame, outs: dict[str, tuple[str, Callable]], radius: int) -> DataFrame:
    """Adds least or largest values over the square: out name to (column of numbers, F.min or F.max). Nulls don't count."""
    across = _line_extremes(px, outs, radius, *AXES[0])
    return _line_extremes(across, {k: (k, how) for k, (_, how) in outs.items()}, radius, *AXES[1])
