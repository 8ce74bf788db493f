"""Queries opN_* and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm import brown, crosstoken, decontaminate, exactdedup, merkle, mixing, pii, quality, sharding, simhash, tokencount, topk, urlfilter
from assetloom.llm.common import crc_of_id, shared_dir, table

QUERY_EVERY = 50
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 512


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards come from a stored map, and those of one shard more from its next version."""
    path = sharding.new_map(spark, sharding.SHARDS)
    maps = {"shard": sharding.read_map(spark, path, 1), "grown_shard": sharding.read_map(spark, path, sharding.grow(spark, path, 1, sharding.SHARDS + 1))}
    rows = sharding.assign(table(spark, sf_dir, "documents"), maps)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = crc_of_id(F.col("doc_id")) % quality.FOLDS == quality.HELD_OUT_FOLD
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's cache is a new one, so its cost is that of a first run."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return crosstoken.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exactdedup.mark(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_top_k, op2_pii, op3_url_filter, op4_virtual_slots, op5_simhash, op6_brown, op7_source_mix, op8_quality, op9_token_counts, op10_decontaminate, op11_cross_tokens, op12_exact_dedup, op13_merkle, pipeline)}
ORACLE_SQL: dict[str, str] = {
    "op1_top_k": f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * cast(x as double))) as v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.v, d.v) as bigint) as score
      from v q join v d on d.vec_id <> q.vec_id where q.vec_id % {QUERY_EVERY} = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= {topk.TOP}""",
    "op3_url_filter": urlfilter.sql(),
    "op12_exact_dedup": exactdedup.sql(),
    "op13_merkle": merkle.sql(),
}
