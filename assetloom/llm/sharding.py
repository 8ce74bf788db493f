"""Sharding by fixed virtual slots and a stored, versioned slot-to-shard map. DataFrame functions only.

A record's virtual slot depends on its id alone. A map of a few thousand entries says which shard
holds each slot; growing and rebalancing write a new version of that map and never touch the hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetloom.llm.common import shared_dir

SLOTS = 4096
SHARDS = 16
#: The rows of a virtual slot are numbered in so many pieces, by their text, so that no piece is a hot group.
PIECES = 64


def grown(entries: list[int], shards: int) -> list[int]:
    """A new map for ``shards`` shards: each new one takes an equal share of the slots, each slot from
    the shard that has most (the lowest number first), and nothing else moves."""
    held: list[list[int]] = [[] for _ in range(shards)]
    for s, k in enumerate(entries):
        held[k].append(s)
    for new in range(max(entries, default=-1) + 1, shards):
        for _ in range(len(entries) // (new + 1)):
            donor = max(range(new), key=lambda k: (len(held[k]), -k))
            held[new].append(held[donor].pop())
    place = {s: k for k, own in enumerate(held) for s in own}
    return [place[s] for s in range(len(entries))]


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot, by growing from one shard."""
    return grown([0] * slots, shards)


def write_map(spark: SparkSession, path: str, version: int, entries: list[int]) -> None:
    """Stores a version of the map, one row a slot. Versions are only added; writing one again is an error."""
    rows = spark.createDataFrame([(s, k) for s, k in enumerate(entries)], "virtual_slot int, shard int")
    rows.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(virtual_slot, shard) of one version; as many rows as there are slots."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def _entries(spark: SparkSession, path: str, version: int) -> list[int]:
    return [r.shard for r in read_map(spark, path, version).orderBy("virtual_slot").collect()]


def new_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> str:
    """Stores version 1 of a new map in the shared folder and returns its path."""
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    write_map(spark, path, 1, slot_map(shards, slots))
    return path


def grow(spark: SparkSession, path: str, version: int, shards: int) -> int:
    """Stores the next version, for more shards, and returns its number."""
    write_map(spark, path, version + 1, grown(_entries(spark, path, version), shards))
    return version + 1


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds virtual_slot from doc_id alone; a null id hashes like any value."""
    return docs.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)).cast("int"))


def _measured(docs: DataFrame, slots: int, *more: Column) -> DataFrame:
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return with_slots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *more), slots)


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) for every slot, also the empty ones; at most ``slots`` rows."""
    used = _measured(docs, slots).groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def rebalanced(entries: list[int], sizes: list[int], shards: int, tolerance: float = 0.02) -> list[int]:
    """A new map in which slots moved from the fullest to the emptiest shard until they differ by at
    most ``tolerance`` of the mean or no single move helps. Every other slot stays where it is."""
    out, load = list(entries), [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for s, k in enumerate(entries):
        load[k] += sizes[s]
        own[k].append(s)
    for _ in range(len(entries)):
        hi, lo = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        if gap <= tolerance * sum(load) / shards:
            break
        fit = [s for s in own[hi] if 0 < sizes[s] < gap]
        if not fit:
            break
        s = min(fit, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        own[hi].remove(s)
        own[lo].append(s)
        load[hi] -= sizes[s]
        load[lo] += sizes[s]
        out[s] = lo
    return out


def rebalance(docs: DataFrame, path: str, version: int, shards: int = SHARDS, slots: int = SLOTS) -> int:
    """Edits the stored map by the bytes that ``docs`` have in each slot: writes the next version, returns its number.

    One row a slot reaches the driver. A slot that holds more than its shard's share can't be divided;
    then the others leave its shard.
    """
    spark = docs.sparkSession
    sizes = [r.bytes for r in slot_bytes(docs, slots).orderBy("virtual_slot").collect()]
    write_map(spark, path, version + 1, rebalanced(_entries(spark, path, version), sizes, shards))
    return version + 1


def assign(docs: DataFrame, maps: dict[str, DataFrame], slots: int = SLOTS, keep: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, virtual_slot, slot_bytes, the shard by each of
    ``maps`` (column name to stored map; the first is the one in force) and slot. With ``keep`` the columns of ``docs``
    come first; one that has the name of a result column gives way to it.

    slot numbers the rows of a shard from 0 without gaps, by virtual slot. Rows are counted for each
    slot and each of its ``PIECES`` by text, so no task sorts a whole shard or all rows without an id.
    Null texts have size 1 and the crc32 of nothing; null ids share one virtual slot; repeated ids
    share theirs and get slots of their own; no rows give no rows. Columns may have any names.
    """
    in_pieces = lambda rows: rows.withColumn("piece", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PIECES)).cast("int"))
    counts = in_pieces(_measured(docs, slots)).groupBy("virtual_slot", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    counts = counts.withColumn("slot_bytes", F.sum("bytes").over(Window.partitionBy("virtual_slot")))
    for name, entries in maps.items():
        counts = counts.join(F.broadcast(entries.withColumnRenamed("shard", name)), "virtual_slot")  # a row a slot
    earlier = F.sum("rows").over(Window.partitionBy(next(iter(maps))).orderBy("virtual_slot", "piece").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("virtual_slot", "piece", *maps, "slot_bytes", F.coalesce(earlier, F.lit(0)).alias("earlier"))

    rows = in_pieces(_measured(docs, slots, *([F.struct(*docs.columns).alias("shard_row")] if keep else [])))
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "piece").orderBy("doc_id", "text_crc32", "size")) - 1
    # At most slots * PIECES rows, whatever the documents are.
    placed = rows.withColumn("inside", inside).join(F.broadcast(counts), ["virtual_slot", "piece"])
    found = ["doc_id", "size", "text_crc32", "virtual_slot", "slot_bytes", *maps]
    slot = (F.col("earlier") + F.col("inside")).cast("long").alias("slot")
    if not keep:
        return placed.select(*found, slot)
    kept = [F.col("shard_row")[c].alias(c) for c in docs.columns if c not in [*found[1:], "slot"]]
    return placed.select(*kept, *found[1:], slot)
