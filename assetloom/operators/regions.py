"""Regions of equal pixels: runs along rows, and connected components of the links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.operators.components import connected_components, contracted
from assetloom.operators.evaluation import ordinal_ranks
from assetloom.session import cut

#: Rows of an image whose links go to one task.
BAND = 256


def row_runs(px: DataFrame, mask: str, value: int = 1) -> DataFrame:
    """(image, y, x0, x1): the maximal runs along rows of pixels that have ``value``."""
    own = px.where(F.col(mask) == value).select("image", "y", "x")
    run = F.col("x") - F.row_number().over(Window.partitionBy("image", "y").orderBy("x"))
    return own.withColumn("run", run).groupBy("image", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def labelled_runs(px: DataFrame, mask: str, value: int = 1, diagonal: bool = True) -> DataFrame:
    """(image, component, y, x0, x1) of the pixels that have ``value``; a component is named by a number, the
    least that of its first pixel.

    Diagonal neighbours join foreground; leave them out for the background. What is linked are runs
    along rows, not pixels. A run's number is its image's, then its place, so numbers never clash (for
    sides below 32,768 and up to 2^33 images).
    """
    images = ordinal_ranks(px.select("image").distinct(), ["image"], "image_number")
    runs = row_runs(px, mask, value).join(images, "image")
    place = lambda c: F.col(c).cast("long")
    runs = cut(runs.select("image", "y", "x0", "x1", (F.shiftleft(F.col("image_number").cast("long"), 30) + place("y") * (1 << 15) + place("x0")).alias("node")))
    reach = 1 if diagonal else 0
    below = runs.select("image", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("node").alias("v"))
    links = runs.join(below, ["image", "y"]).where((F.col("x0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("x1") + reach))
    # The links of an image, a band of rows at a time, lie together and in order.
    together = links.select(F.col("node").alias("u"), "v", "image", F.floor(F.col("y") / BAND).alias("band")).repartition("image", "band").sortWithinPartitions("u")
    roots = connected_components(contracted(together.select("u", "v")))
    return runs.join(roots, "node", "left").select("image", F.coalesce("root", "node").alias("component"), "y", "x0", "x1")


def pixels_of(runs: DataFrame) -> DataFrame:
    """(image, y, x, component)"""
    return runs.select("image", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "component")


def label(px: DataFrame, mask: str, value: int = 1, diagonal: bool = True) -> DataFrame:
    """(image, y, x, component), see ``labelled_runs``."""
    return pixels_of(labelled_runs(px, mask, value, diagonal))


def run_areas(runs: DataFrame) -> DataFrame:
    """Area and bounding box of each component."""
    return runs.groupBy("image", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"), F.min("y").alias("y0"), F.min("x0").alias("x0"), F.max("y").alias("y1"), F.max("x1").alias("x1"))


def hole_runs(background: DataFrame, sizes: DataFrame) -> DataFrame:
    """The runs of background components that don't touch the frame. sizes: (image, h, w), the last row and column."""
    inside = run_areas(background).join(sizes, "image").where("y0 > 0 and x0 > 0 and y1 < h and x1 < w").select("image", "component")
    return background.join(inside, ["image", "component"], "left_semi")


def filled_runs(runs: DataFrame, holes: DataFrame) -> DataFrame:
    """``runs`` with their holes filled. A hole belongs to the component left of its first pixel.

    Other pieces that lie in a hole stay pieces of their own.
    """
    first = holes.groupBy("image", "component").agg(F.min(F.struct("y", "x0")).alias("f")).select("image", F.col("component").alias("hole"), F.col("f.y").alias("y"), (F.col("f.x0") - 1).alias("x1"))
    owner = first.join(runs.select("image", "y", "x1", "component"), ["image", "y", "x1"]).select("image", "hole", "component")
    own = holes.withColumnRenamed("component", "hole").join(owner, ["image", "hole"]).select("image", "component", "y", "x0", "x1")
    w = Window.partitionBy("image", "component", "y").orderBy("x0")
    apart = F.coalesce((F.col("x0") > F.lag("x1").over(w) + 1).cast("int"), F.lit(1))
    return runs.unionByName(own).withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(w)).groupBy("image", "component", "y", "stretch").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("stretch")
