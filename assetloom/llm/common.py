"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.session import cut, dealt_out, shared_dir, stored, table

__all__ = ["WORD", "ascii_lower", "crc_of_id", "cut", "dealt_out", "repeated", "shared_dir", "stored", "table", "utf8", "word_count"]

#: A word is a maximal run of characters other than ASCII white space. ``bytes.split()`` cuts
#: UTF-8 at the same six characters, so Python and SQL see the same words.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(text: Column) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))



def repeated(rows: DataFrame, times: str, name: str, at_once: int = 1 << 16) -> DataFrame:
    """A row for each of 0 to ``times`` - 1 in ``name``, a bounded array at a time."""
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / at_once)))
    pieces = rows.where(F.col(times) > 0).withColumn("repeated_piece", piece)
    first = F.col("repeated_piece") * at_once
    return pieces.withColumn(name, F.explode(F.sequence(first, F.least(first + at_once, F.col(times)) - 1))).drop("repeated_piece")
