"""SimHash near-duplicates: segment popcounts as a grid embedding, then exact verification.

The Hamming distance of two fingerprints is at least the Manhattan distance of their vectors of
per-segment bit counts. Texts that differ little therefore lie close together on a grid of small
integers. Two grid points at Manhattan distance 2 or less always have a grid point within distance 1
of both, so every fingerprint is listed at its own point and at the points next to it, and only
fingerprints that meet are compared bit by bit.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from assetloom.llm.common import cut, dealt_out, utf8
from assetloom.operators.components import connected_components

BITS = 64
#: Sixteen segments of four bits: 33 grid points a fingerprint, and unrelated fingerprints rarely meet.
SEGMENTS = 16
MAX_DISTANCE = 2
#: A grid point with more fingerprints than this is handled by shared one-bit neighbours, not pairs.
CROWDED = 64
_CHUNK = 1 << 14
_hash = partial(xxh64_digest, seed=42)


def fingerprint(raw: bytes, shingle_words: int = 3) -> int:
    """The signed 64-bit SimHash of one whole text (UTF-8). No words give 0."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    total, ones = 0, np.zeros(BITS, dtype=np.int64)
    while block := b"".join(map(_hash, islice(shingles, _CHUNK))):
        bits = np.unpackbits(np.frombuffer(block, dtype=np.uint8).reshape(-1, BITS // 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint16)
        total += len(bits)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def _fingerprint_batches(batches, shingle_words):
    for batch in batches:
        values = [fingerprint(x, shingle_words) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp long), one row for each row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return texts.mapInArrow(partial(_fingerprint_batches, shingle_words=shingle_words), "doc_id long, fp long")


def _segment_width() -> int:
    return BITS // SEGMENTS


def _grid_points(fp: Column) -> Column:
    """The fingerprint's grid point and its neighbours, each packed into a long.

    A count of 0 to 4 is stored plus one in three bits, so that a step of one up or down fits.
    """
    width = _segment_width()
    mask = (1 << width) - 1
    own = sum(((F.bit_count(F.shiftrightunsigned(fp, s * width).bitwiseAND(F.lit(mask))) + 1).cast("long") * F.lit(1 << (3 * s)) for s in range(SEGMENTS)), F.lit(0).cast("long"))
    steps = F.array(*[F.lit(x).cast("long") for s in range(SEGMENTS) for x in (1 << (3 * s), -(1 << (3 * s)))], F.lit(0).cast("long"))
    return F.transform(steps, lambda x: own + x)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_DISTANCE


def near_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between the distinct fingerprints in ``fps`` (column fp) that keep all its components.

    Grid points with at most ``CROWDED`` fingerprints give every verified pair. The fingerprints of
    fuller points are instead linked through shared one-bit neighbours: two fingerprints differ in at
    most two bits exactly if some 64-bit number is within one bit of both, so a star around each
    such number joins the same components with 65 rows a fingerprint, however many copies there are.
    """
    # Each fingerprint becomes 33 rows: without an exchange of its own, few small partitions would make them all.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = fps.repartition(tasks, "fp").select("fp", F.explode(_grid_points(F.col("fp"))).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    shared = cut(counts.where("n > 1"))
    twos = shared.where("n = 2").where(_near("u", "v")).select("u", "v")

    some = cells.join(shared.where(F.col("n").between(3, CROWDED)).select("cell"), "cell")
    pairs = some.withColumnRenamed("fp", "u").join(some.withColumnRenamed("fp", "v"), "cell")
    pairs = pairs.where("u < v").where(_near("u", "v")).select("u", "v")

    full = cells.join(shared.where(F.col("n") > CROWDED).select("cell"), "cell").select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(x if x < 1 << 63 else x - (1 << 64)).cast("long")) for x in (1 << i for i in range(BITS))]
    around = full.select("fp", F.explode(F.array(*flips)).alias("centre"))
    least = around.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("centre", "v")
    stars = around.join(least, "centre").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return twos.union(pairs).union(stars)


def near_duplicates(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id long), one row for each row of ``docs``.

    component_id is the least doc_id in the component of fingerprints that links of at most
    ``MAX_DISTANCE`` differing bits join. Null texts are empty; empty texts have fingerprint 0 and
    are linked like any other. Null ids keep their row and never become a component_id unless the
    component has no other id (then null). Repeated rows stay repeated. Other columns are ignored.
    Copies collapse to one fingerprint before anything is compared. Fingerprints at grid points that
    more than ``CROWDED`` share are linked by shared one-bit neighbours, which finds the same components.
    """
    own = cut(fingerprints(docs, shingle_words))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    members = connected_components(near_links(fps.select("fp"))).withColumnRenamed("node", "fp")
    members = members.join(fps, "fp")
    least = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = members.select("fp", "root").join(dealt_out(least), "root").select("fp", "component_id")
    of_fp = fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return own.join(dealt_out(of_fp), "fp").select("doc_id", "fp", "component_id")
