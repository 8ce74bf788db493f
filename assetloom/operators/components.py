"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.session import cut, dealt_out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(dealt_out(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(dealt_out(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a root, which has links from others only: then nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up = 1 and down = 1").count() == 0


#: Links that are contracted at once.
LINKS_AT_ONCE = 1 << 17


def star_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) by these links, for all nodes but the least ones."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while ((high := np.maximum(root[a], root[b])) != (low := np.minimum(root[a], root[b]))).any():
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contracted_batches(batches):
    held, n = [], 0

    def given():
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in star_links(u, v)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= LINKS_AT_ONCE:
            yield given()
            held, n = [], 0
    if held:
        yield given()


def contracted(edges: DataFrame) -> DataFrame:
    """Links (two long columns u, v) with the same components: of each ``LINKS_AT_ONCE`` in the order they lie in, the stars.

    Pays where what is linked lies together; then hardly any round is left to ``connected_components``.
    """
    return edges.mapInArrow(_contracted_batches, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns u, v); root is the least node reachable.

    Self links and repeated links are ignored; no links give no rows. The links of each task are contracted first, then
    each ``LINKS_AT_ONCE`` of what is left; so few links are done in one task and need no round, and their many small
    exchanges stay away from the driver. Each round is cut by a checkpoint; only a count reaches the driver. The number of rounds grows
    with the logarithm of a component's size. A node with many links is a hot key of the joins, whose
    other sides are dealt out first, so that Spark can split it.
    """
    clean = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now = cut(contracted(clean))
    parts = now.count() // LINKS_AT_ONCE + 1
    now = cut(contracted(now.coalesce(parts)))
    while parts > 1 and not _stars(now):
        now = cut(_small_star(_large_star(now).distinct()).distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
