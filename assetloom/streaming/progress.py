"""Job progress as Structured Streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StructField, StructType

from assetloom.operators.reporting import summary_columns


def live_summary(results: DataFrame) -> DataFrame:
    """Partial summary of each job so far (complete or update mode); throughput is 0 until a job ends."""
    return results.groupBy("job_id").agg(*summary_columns(F.lit(0.0)))


def progress_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed_counts(events: DataFrame, at: str, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Event-time counts with a watermark. ``at`` may lack a time zone; it is read in the session's."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Processes what is there in update mode; returns the last state of each key.

    Each batch's changed rows go to a file folder of their own, which a batch that is run again
    overwrites; nothing passes the driver. The watermark, if there is one, evicts old state.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder + "/rows") if query.lastProgress else spark.createDataFrame([], schema)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("last"))
    return last.select(*keys, "last.*")


def newest(stream: DataFrame, key: str, sequence: str, limit: int, buckets: int = 4096) -> DataFrame:
    """(key, newest): the ``limit`` greatest sequence numbers of each key so far, greatest first, in update mode.

    What a key's list pushes out is gone. The lists of one of ``buckets`` parts of the keys are one state, read and
    written at once: a call for each key would cost more than its work. Null numbers are left out.
    """
    kind = stream.schema[key].dataType.simpleString()

    def greatest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates().sort_values(["key", "number"], ascending=[True, False])
        return rows[rows.groupby("key", dropna=False).cumcount() < limit]

    def keep(_, batches, state: GroupState):
        held, seen = pd.DataFrame({"key": pd.Series(dtype=object), "number": pd.Series(dtype="int64")}), []
        if state.exists:
            keys, lists = state.get
            held = pd.DataFrame({"key": pd.Series(keys, dtype=object), "number": lists}).explode("number").astype({"number": "int64"})
        for batch in batches:
            seen.append(batch["key"].drop_duplicates())
            held = greatest(pd.concat([held, batch[["key", "number"]]]))
        lists = held.groupby("key", dropna=False, sort=False)["number"].agg(list).reset_index()
        lists["key"] = lists["key"].astype(object).where(lists["key"].notna(), None)
        state.update((lists["key"].tolist(), lists["number"].tolist()))
        changed = pd.concat(seen)
        yield lists[lists["key"].isin(changed)].rename(columns={"number": "newest"})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(sequence).cast("long").alias("number")).where("number is not null")
    parts = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("part")
    lists = parts.applyInPandasWithState(keep, "key string, newest array<long>", "keys array<string>, lists array<array<bigint>>", "update", "NoTimeout")
    return lists.select(F.col("key").cast(kind).alias(key), "newest")
