"""Exact duplicates by salted combining, in DataFrame functions only.

Texts are equal if they are identical without white space. Of equal texts the row with the most code
points stays, then the one with the smallest id. Copies meet three times: inside each task, inside
salted groups, and as the salts' winners; every time by digest *and* full content, so that two texts
that share a digest never count as equal. A text that a third of all rows hold reaches a task once from
each task before, dealt over the salts.

Contents travel in those steps only. The rows themselves go by digest: if all rows of a digest have one
content, the digest says which group a row is in. Digests that several contents share take a way of their own, by
content.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import dealt_out, stored

SALTS = 32
#: The characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: Rows of one kind that are written out at a time.
AT_ONCE = 1 << 16
_ID, _SPAN = 1 << 63, 1 << 65


def content_of(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit("")).cast("string"))


def sha256(content: Column) -> Column:
    # Never null, and said so: else joins test it, and compute it, once more.
    return F.coalesce(F.unhex(F.sha2(content.cast("binary"), 256)), F.lit(b""))


def order_of(text: Column, doc_id: Column) -> Column:
    """One number that is smaller for rows to be preferred: more code points first, then smaller ids, null last.

    A number, unlike a struct, is updated in place by hash aggregation, so no text has to be sorted.
    """
    length = F.coalesce(F.char_length(text), F.lit(0))
    shorter = (F.lit((1 << 31) - 1) - length).cast("decimal(10,0)") * F.lit(Decimal(_SPAN))
    place = F.coalesce(doc_id.cast("decimal(20,0)") + F.lit(Decimal(_ID)), F.lit(Decimal(2 * _ID)))
    return (shorter + place).cast("decimal(38,0)")


def id_of(order: Column) -> Column:
    """The id that ``order_of`` put in."""
    place = order % F.lit(Decimal(_SPAN))
    return F.when(place < F.lit(Decimal(2 * _ID)), (place - F.lit(Decimal(_ID))).cast("long"))


def _keyed(docs: DataFrame, digest, *more: Column) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(*more, doc_id.alias("doc_id"), order_of(F.col("text"), doc_id).alias("order"), content_of(F.col("text")).alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def winners(keyed: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, content, best, n): the preferred row's order and the number of rows of each content."""
    combined = keyed.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "content", "salt").agg(F.min("order").alias("best"), F.count("*").alias("n"))
    return combined.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def _by_digest(keyed: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """(digest, best, n) of digests with one content, and the digests that several contents share."""
    merged = winners(keyed, salts).groupBy("digest").agg(F.count("*").alias("contents"), F.min("best").alias("best"), F.sum("n").alias("n"))
    found = stored(merged, "exact-dedup")
    return found.where("contents = 1").drop("contents"), found.where("contents > 1").select("digest")


def _marked(rows: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each of ``rows``; of rows that equal the winner's in every respect the first stays."""
    kinds = rows.groupBy(*keys, "doc_id", "order").agg(F.count("*").alias("copies"))
    met = kinds.join(best, keys)
    pieces = met.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / AT_ONCE))))
    each = pieces.withColumn("inside", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(AT_ONCE), F.col("copies") - F.col("piece") * AT_ONCE))))
    first = (F.col("piece") == 0) & (F.col("inside") == 1)
    return each.select("doc_id", id_of(F.col("best")).alias("keep_id"), F.col("n").alias("group_size"), ((F.col("order") == F.col("best")) & first).alias("kept"), "digest")


def mark(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for each row of ``docs``.

    Null texts count as empty, and empty texts are a group like any other. A null id comes after all
    ids; ``keep_id`` is null if the row that stays has none. Rows with equal ids, lengths and contents
    are ties: one of them stays. Repeated rows keep their number, and an empty table gives none.
    Columns other than ``doc_id`` (integers) and ``text`` are ignored, whatever their names. ``digest`` may be any function
    of the content; equal digests of different contents cost time, not correctness.
    """
    keyed = _keyed(docs, digest)
    alone, shared = _by_digest(keyed, salts)
    if shared.isEmpty():
        return _marked(keyed.drop("content"), alone, ["digest"])
    apart = _marked(keyed.drop("content").join(shared, "digest", "left_anti"), alone, ["digest"])
    # Rows of digests that several contents share carry their content to the end.
    clashing = keyed.join(shared, "digest", "left_semi")
    return apart.unionByName(_marked(clashing, dealt_out(winners(clashing, salts)), ["digest", "content"]))


def keep_one(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns whatever their names; nulls, empty texts and an
    empty table as in ``mark``. Of rows that tie with the winner any one stays, whole."""
    rows = _keyed(docs, digest, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    alone, shared = _by_digest(rows.drop("row"), salts)
    best = lambda won: won.withColumnRenamed("best", "order").drop("n")
    kept = rows.drop("content").join(best(alone), ["digest", "order"], "left_semi").dropDuplicates(["digest"]).select("row.*")
    if shared.isEmpty():
        return kept
    clashing = rows.join(shared, "digest", "left_semi")
    return kept.union(clashing.join(best(winners(clashing.drop("row"), salts)), ["digest", "content", "order"], "left_semi").dropDuplicates(["digest", "content"]).select("row.*"))


def sql() -> str:
    """The same rows in DuckDB."""
    return r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
k as (select doc_id, length(t) as c, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from d)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from k window w as (partition by text_sha256 order by c desc, doc_id nulls last)"""
