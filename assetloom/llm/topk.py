"""Exact top-k inner products by block-at-a-time pruning.

Vectors are ranged by a coarse order into document blocks; a cell of blocks is what one task call
holds. A block keeps, for every term (component), the largest and the smallest value that it holds; a
query's summed term maxima bound what any of its vectors can score. Each query visits blocks in
descending order of that bound, scores a block through its forward index (the block's own matrix) and
stops when the bound falls below its kth score. Cells have such bounds too, and a query is sent only
to the cells that can hold something for it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import cut

#: Vectors in a block, and rows and queries that one task call holds: for 64 components 16 and 32 MB.
BLOCK_ROWS, CELL_ROWS, CELL_QUERIES = 256, 32_768, 65_536
#: Least rows of a cell where there are fewer cells than cores.
_FEWEST_ROWS = 1024
#: So many cells' bounds (1 KB each for 64 components) are broadcast at once; more take more passes over the queries.
SENT_CELLS = 65_536
#: Bounds of queries and cells that a Python worker computes at once.
BOUNDS_AT_ONCE = 4_000_000
#: So many pairs of cells and parts of the queries are broadcast; more are joined by shuffling.
SENT_PAIRS = 500_000
TOP = 5
SCALE = 256
_EXACT = 2**53


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component; null for a vector that is null or has a null or non-finite component."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")


def _order(v: Column) -> list[Column]:
    """Places alike vectors near each other: by the signs of the leading components, then by id."""
    signs = F.aggregate(F.slice(v, 1, 16), F.lit(0), lambda acc, x: acc * 2 + F.when(x >= 0, 1).otherwise(0))
    return [signs, F.col("vec_id")]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers: in float64 where that is exact, else in 64-bit integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a @ b.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima: the most that any vector between low and high can score, for each query (rows) and box (columns)."""
    return _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)


class _Best:
    """The best rows of each query so far; ``kth`` is a score that the query is known to reach, -inf at first."""

    def __init__(self, floor: np.ndarray, top: int):
        self.kth, self.top, self.waiting = floor, top, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, query_ids: np.ndarray, own: np.ndarray, scores: np.ndarray) -> None:
        """scores: of the queries ``rows`` (with their ids) with the vectors ``own``; those below a query's kth are dropped."""
        near = np.where(own[None, :] == query_ids[:, None], -np.inf, scores.astype(float))
        if near.shape[1] >= self.top:
            self.kth[rows] = np.maximum(self.kth[rows], np.partition(near, -self.top, axis=1)[:, -self.top])
        # Beyond 2^53 floats are near the scores only; the exact ones decide in settle().
        r, c = np.nonzero((near >= (self.kth[rows] - 1e-9 * np.abs(self.kth[rows]))[:, None]) & (near > -np.inf))
        self.parts.append((rows[r], own[c], scores[r, c].astype(np.int64)))
        self.waiting += len(r)
        if self.waiting > 4 * self.top * len(self.kth) + 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of the best so far, by query, then score and vec_id."""
        q, i, s = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = place == self.top - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], s[last])
        kept = place < self.top
        self.parts, self.waiting = [(q[kept], i[kept], s[kept])], 0
        return self.parts[0]


def search_cell(queries, query_ids, floor, matrix, ids, top):
    """((query index, vec_id, score) arrays of each query's best rows of one cell, number of blocks scored).

    floor: a score that each query is known to reach, or -inf.
    """
    starts = range(0, len(matrix), BLOCK_ROWS)
    high = np.stack([matrix[s : s + BLOCK_ROWS].max(axis=0) for s in starts])
    low = np.stack([matrix[s : s + BLOCK_ROWS].min(axis=0) for s in starts])
    bounds = _bounds(queries, high, low)
    best = _Best(np.array(floor, dtype=float), top)
    order, scored = np.argsort(-bounds, axis=1, kind="stable"), 0
    for block in order.T:
        bound = bounds[np.arange(len(queries)), block].astype(float)
        alive = bound + 1e-9 * np.abs(bound) >= best.kth
        if not alive.any():
            break
        for b in np.unique(block[alive]):
            rows = np.flatnonzero(alive & (block == b))
            part = slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS)
            best.add(rows, query_ids[rows], ids[part], _product(queries[rows], matrix[part]))
            scored += len(rows)
    return best.settle(), scored


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    vectors = column.combine_chunks()
    out, lengths = np.zeros((len(vectors), width)), vectors.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_BOXED = pa.schema([*_FOUND, ("cell", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])


def _searched(rows: pa.Table, queries: pa.Table, top: int) -> tuple[list, np.ndarray | None]:
    """(result columns, the cell's matrix) of one cell of rows and one of queries."""
    lengths = [int(pc.max(pc.list_value_length(v)).as_py()) for v in (rows["v"], queries["q_v"]) if len(v)]
    matrix = _matrix(rows["v"], max(lengths)) if len(rows) else None
    if matrix is None or not len(queries):
        return [[], [], [], []], matrix
    floor = [-np.inf if x is None else x for x in queries["floor"].to_pylist()]
    keys, ids = queries["query_row"].to_numpy(), queries["q_id"].to_numpy()
    (place, vec_id, score), _ = search_cell(_matrix(queries["q_v"], max(lengths)), ids, floor, matrix, rows["vec_id"].to_numpy(), top)
    return [keys[place], ids[place], vec_id, score], matrix


def _search(rows: pa.Table, queries: pa.Table, top: int) -> pa.Table:
    return pa.table(_searched(rows, queries, top)[0], schema=_FOUND)


def _search_own(rows: pa.Table, queries: pa.Table, top: int) -> pa.Table:
    """The search of a cell by its own queries, and a row with the cell's bounds."""
    found, matrix = _searched(rows, queries, top)
    more = len(found[0])
    out = pa.table([*found, *([None] * more for _ in range(3))], schema=_BOXED)
    if matrix is None:
        return out
    sides = [[side.astype(np.int64)] for side in (matrix.max(axis=0), matrix.min(axis=0))]
    return pa.concat_tables([out, pa.table([*([None] for _ in range(4)), rows["cell"][:1], *sides], schema=_BOXED)])


def _ship_batches(batches, boxes, parts, vectors):
    """Each query once for each cell whose bound reaches its floor; without ``vectors`` only which cells and parts meet."""
    cells, high, low = boxes.value
    step = max(1, BOUNDS_AT_ONCE // len(cells))
    for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
        asked = pa.Table.from_batches([batch])
        width = max(int(pc.max(pc.list_value_length(asked["q_v"])).as_py()), high.shape[1])
        wider = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))  # noqa: E731, B023
        bounds = _bounds(_matrix(asked["q_v"], width), wider(high), wider(low)).astype(float)
        floor = np.array([-np.inf if x is None else x for x in asked["floor"].to_pylist()])
        reach = bounds + 1e-9 * np.abs(bounds) >= floor[:, None]
        part = asked["query_row"].to_numpy() % parts
        for k, cell in enumerate(cells.tolist()):
            some = np.flatnonzero(reach[:, k])
            own = np.unique(part[some]) if not vectors else part[some]
            columns = [pa.array(np.full(len(own), cell, np.int32)), pa.array(own.astype(np.int32))]
            if not vectors:
                yield pa.RecordBatch.from_arrays(columns, ["q_cell", "q_part"])
            elif len(some):
                rest = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*columns, *(rest.column(n) for n in ("query_row", "q_id", "q_v", "floor"))], ["q_cell", "q_part", "query_row", "q_id", "q_v", "floor"])


def _ranked(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def _boxes(near: DataFrame):
    """Arrays (cells, high, low) of at most SENT_CELLS cells each."""
    known = near.where("high is not null").select("cell", "high", "low")
    last = known.agg(F.max("cell")).first()[0]
    for start in range(0, -1 if last is None else last + 1, SENT_CELLS):
        rows = known.where(F.col("cell").between(start, start + SENT_CELLS - 1)).toArrow()
        if len(rows):
            width = int(pc.max(pc.list_value_length(rows["high"])).as_py())
            yield rows["cell"].to_numpy(), *(_matrix(rows[side], width).astype(float) for side in ("high", "low"))


def top_k(rows: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` largest inner products of each query row, ties to the smaller vec_id.

    ``rows`` and ``queries`` have vec_id and embedding. A query is never compared with rows of its own
    id. Vectors that are null or hold null or non-finite components, and null ids, take no part; a
    shorter vector counts as filled with zeros, an empty one scores 0. Repeated query rows are
    answered one by one; repeated rows are separate candidates. Products beyond 64 bits are not
    defined. No rows or no queries give no result. Other columns are ignored.

    Rows and queries are ranged together into cells of alike vectors. First every query meets the rows
    of its own cell, which gives it a score to reach; then it is sent to the cells whose bound reaches
    that, in parts of the queries, a cell and a part a task call, which prunes by blocks.
    """
    spark = rows.sparkSession
    both = _vectors(rows).withColumn("is_query", F.lit(False)).union(_vectors(queries).withColumn("is_query", F.lit(True)))
    counts = both.groupBy("is_query").count().collect()
    n, m = (next((r["count"] for r in counts if r.is_query is side), 0) for side in (False, True))
    cells = max(1, -(-n // CELL_ROWS), min(spark.sparkContext.defaultParallelism, n // _FEWEST_ROWS))
    ranged = both.repartitionByRange(cells, *_order(F.col("v"))).sortWithinPartitions(*_order(F.col("v")))
    placed = cut(ranged.select("*", F.spark_partition_id().alias("cell"), F.monotonically_increasing_id().alias("query_row")))
    data = placed.where("not is_query").select("cell", "vec_id", "v")
    asked = placed.where("is_query").select(F.col("cell").alias("q_cell"), "query_row", F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"))

    schema = "query_row long, query_id long, vec_id long, score long"
    own = data.groupBy("cell").cogroup(asked.withColumn("floor", F.lit(None).cast("long")).groupBy("q_cell"))
    near = cut(own.applyInArrow(partial(_search_own, top=top), f"{schema}, cell int, high array<long>, low array<long>"))
    floors = near.where("query_row is not null").groupBy("query_row").agg(F.when(F.count("*") >= top, F.min("score")).alias("floor"))
    asked = cut(asked.drop("q_cell").join(floors, "query_row", "left").select("query_row", "q_id", "q_v", "floor"))

    parts, shipped, meeting = max(1, -(-m // CELL_QUERIES)), None, None
    for box in _boxes(near):
        sent = spark.sparkContext.broadcast(box)
        there = asked.mapInArrow(partial(_ship_batches, boxes=sent, parts=parts, vectors=True), "q_cell int, q_part int, query_row long, q_id long, q_v array<long>, floor long")
        pairs = asked.mapInArrow(partial(_ship_batches, boxes=sent, parts=parts, vectors=False), "q_cell int, q_part int").distinct()
        shipped, meeting = (there, pairs) if shipped is None else (shipped.union(there), meeting.union(pairs))
    if shipped is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    meeting = cut(meeting.select(F.col("q_cell").alias("cell"), F.col("q_part").alias("part")))
    spread = data.join(F.broadcast(meeting) if meeting.count() <= SENT_PAIRS else meeting, "cell")
    found = spread.groupBy("cell", "part").cogroup(shipped.groupBy("q_cell", "q_part")).applyInArrow(partial(_search, top=top), schema)
    return _ranked(found, top).select("query_id", "rank", "vec_id", "score")
