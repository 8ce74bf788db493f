"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are permuted by a seeded hash, and the source's stream of words, read up to
three times, is cut into blocks of equal words. The blocks that a source owes are its quota; a binary
tree over the output shards splits all quotas exactly by multivariate hypergeometric draws, and each
shard takes a disjoint range of each source's blocks. A document is read when the middle of its words
falls in a block that some shard has drawn, by that shard, which orders its rows by another hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import cut, dealt_out, word_count
from assetloom.operators.evaluation import ordinal_ranks

#: A source is read at most so many times.
EPOCHS = 3
#: Blocks have at most this many words, or as many more as keep all quotas below MOST_BLOCKS (which the draws need).
BLOCK_WORDS = 4096
MOST_BLOCKS = 1 << 29
SHARDS = 16
SEED = 20240607
#: Sources are dealt to so many parts, whose quotas the driver splits; each part splits those of its own sources.
PARTS = 64
#: A source's documents are first counted in hash ranges of about so many words, each numbered on its own.
RANGE_WORDS = 1 << 24
_LEAST_RANGES, _MOST_RANGES = 10, 20
#: A plan of at most so many sources is broadcast, a larger one is joined by shuffling.
SENT_SOURCES = 10_000


def _draw(*parts) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def target_words(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares of all words by weight, at most EPOCHS
    times a source's own words, the excess dealt again by weight until no source is above its limit.

    Only sums over the sources reach the driver, three numbers a round.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = EPOCHS * F.col("source_size")
    rate, capped = None, -1
    while True:
        below = F.lit(True) if rate is None else F.col("weight") * F.lit(rate) <= limit
        free, spent, n = sources.agg(F.sum(F.when(below, F.col("weight"))), F.sum(F.when(~below, limit)), F.count(F.when(~below, 1))).first()
        rate = (total - (spent or 0)) / free if free else 0.0
        if n == capped:
            break
        capped = n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(rate)), limit.cast("double")))


def with_weights(sizes: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """Numbers the sources by code point, null last, and repeats the weights over them. No task sorts all sources."""
    ranked = ordinal_ranks(sizes, [F.col("source").isNull(), "source"], "place")
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).drop("place")


def _split(totals, quotas: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows: shards, columns: sources. totals: how many blocks each shard gets; quotas: how many each source owes."""
    if len(totals) == 1:
        return quotas[None, :]
    half = len(totals) // 2
    left = rng.multivariate_hypergeometric(quotas, int(sum(totals[:half])), method="marginals")
    return np.concatenate([_split(totals[:half], left, rng), _split(totals[half:], quotas - left, rng)])


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each shard (rows) and source (columns); the columns add up to ``quotas`` exactly.

    A node's left half draws its share of all blocks without replacement from all sources together;
    the shards' totals differ by at most one.
    """
    total = int(quotas.sum())
    return _split([total * (k + 1) // shards - total * k // shards for k in range(shards)], quotas, rng)


def _splitter(totals: dict[int, list[int]]):
    """The same tree over one part's sources: given its totals a shard, each source's blocks are again hypergeometric."""

    def split_part(sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", na_position="last", kind="stable")
        part = int(sources["part"].iloc[0])
        ends = np.cumsum(_split(totals[part], sources["quota"].to_numpy(dtype=np.int64), np.random.default_rng([SEED, part])), axis=0)
        return pd.DataFrame({"plan_key": sources["plan_key"], "ends": [ends[:, i].tolist() for i in range(len(sources))]})

    return split_part


def _key(source: Column) -> Column:
    """The source as a value that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _plan(rows: DataFrame, weights, shards: int) -> DataFrame:
    """(plan_key, source_size, target, block_words, ends): a row a source. ends[k]: the blocks that shards 0 to k have drawn."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut(target_words(with_weights(cut(sizes), weights)))
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    block = BLOCK_WORDS
    while words / block >= MOST_BLOCKS // 2:
        block *= 2
    key = _key(F.col("source"))
    sources = sources.select("source", key.alias("plan_key"), "source_size", "target", F.ceil(F.col("target") / block).alias("quota"), F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part"))
    quotas = np.zeros(PARTS, dtype=np.int64)
    for r in sources.groupBy("part").agg(F.sum("quota").alias("n")).collect():
        quotas[r.part] = r.n
    by_part = split_quotas(quotas, shards, np.random.default_rng(SEED))
    totals = {k: by_part[:, k].tolist() for k in range(PARTS)}
    drawn = sources.select("source", "plan_key", "quota", "part").groupBy("part").applyInPandas(_splitter(totals), "plan_key string, ends array<long>")
    # Its own equal share of the target, so that whole blocks meet the target exactly.
    return cut(sources.select("plan_key", "source_size", "target", F.try_divide(F.col("target"), F.col("quota")).alias("block_words")).join(drawn, "plan_key"))


def mix_plan(docs: DataFrame, weights=(1, 2, 3), shards: int = SHARDS, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source, source_size, target, copies (array of shard numbers, one
    entry for each time the mix reads the document) and the named ``columns``.

    Null texts have size 0; null sources form one source of their own, the last. Documents without
    words are read as their place in the source decides; a source without words is not read at all.
    Equal ids of equal size may swap places, which changes no size and no number of reads. Of the
    sources only sums over ``PARTS`` parts reach the driver.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"), *columns)
    counted = cut(slim.select("doc_id", "size", "source"))
    # With other columns the texts are read a second time, for the mixture.
    sized = slim if columns else counted
    place = _draw(F.col("doc_id"), F.col("size"))
    total, bits = counted.agg(F.sum("size")).first()[0] or 0, _LEAST_RANGES
    while bits < _MOST_RANGES and total >> bits > RANGE_WORDS:
        bits += 1
    plan = _plan(counted, weights, shards)

    in_range = lambda rows: rows.withColumn("plan_key", _key(F.col("source"))).withColumn("place", place).withColumn("bin", F.shiftrightunsigned("place", 64 - bits).cast("int"))
    bins = in_range(counted).groupBy("plan_key", "bin").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("plan_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("plan_key", "bin", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    inside = F.sum("size").over(Window.partitionBy("plan_key", "bin").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = in_range(sized).withColumn("inside", F.coalesce(inside, F.lit(0))).join(bins, ["plan_key", "bin"])
    few = plan.count() <= SENT_SOURCES
    rows = rows.join(F.broadcast(plan) if few else dealt_out(plan), "plan_key")

    # Read e of a document has its middle at the word e * source_size + earlier + inside + size / 2 of the source's stream.
    middles = F.transform(F.array(*[F.lit(e) for e in range(EPOCHS)]), lambda e: e * F.col("source_size") + F.col("earlier") + F.col("inside") + F.col("size") / 2)
    drawn = F.transform(middles, lambda at: F.size(F.filter("ends", lambda end: end <= F.floor(at / F.col("block_words")))))
    copies = F.filter(F.coalesce(drawn, F.array().cast("array<int>")), lambda k: k < shards)
    known = F.when(F.col("block_words").isNull(), F.array().cast("array<int>")).otherwise(copies)
    return rows.select("doc_id", "size", "source", "source_size", "target", known.alias("copies"), *columns)


def mix(docs: DataFrame, weights=(1, 2, 3), shards: int = SHARDS) -> DataFrame:
    """The mixture itself: the columns of ``docs``, then mix_shard and mix_order, a row for each read.

    mix_order is the row's place key inside its shard: sort by it for the local shuffle. Columns of
    ``docs`` may have any names but these two.
    """
    plan = mix_plan(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("mix_row")), weights, shards, ("mix_row",))
    reads = plan.select("doc_id", "mix_row", F.posexplode("copies").alias("mix_epoch", "mix_shard"))
    order = F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), F.col("mix_epoch"))
    return reads.select("mix_row.*", "mix_shard", order.alias("mix_order"))


def laid_out(mixed: DataFrame) -> DataFrame:
    """``mix``'s rows in the order of its shards and of the local shuffle in each: a file holds a stretch of one
    shard or of neighbouring ones, however large a shard is."""
    return mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
