"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assetloom.llm import decontaminate, mixing, nearcopies, quality, sharding
from assetloom.llm.common import shared_dir, table


#: Whole texts that are handed to a Python worker at once. Spark's default of ten thousand rows is meant for short ones.
TEXTS_AT_ONCE = 250
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXTS_AT_ONCE:
        spark.conf.set(_BATCH, TEXTS_AT_ONCE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; rows are judged one by one, so nulls, repeated rows and ids,
    and an empty table stay as they are (``quality.keep_good``)."""
    _small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; null and empty texts are one group, ids may be null or
    repeat, an empty table stays empty (``nearcopies.keep_one``)."""
    _small_batches(spark)
    return nearcopies.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts hold none, repeated rows go or stay
    together, an empty table stays empty (``decontaminate.keep_clean``)."""
    _small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time it reads a document, laid out by the mixture's shards and their shuffle.

    Documents without words or of a null source, repeated rows and ids, ties and an empty table are handled as ``mixing.mix`` says.
    """
    return mixing.laid_out(mixing.mix(docs)).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its texts, its shard and its place there, by a stored map that was rebalanced by bytes.

    Null ids share a slot, null texts count no bytes, and columns with the operator's names give way to its own.
    """
    path = sharding.new_map(spark, sharding.SHARDS)
    version = sharding.rebalance(docs, path, 1)
    return sharding.assign(docs, {"shard": sharding.read_map(spark, path, version)}, keep=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier, the fingerprints and the alignments can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and read by the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
