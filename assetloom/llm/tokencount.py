"""Token counts through a digest cache.

Counts are stored by the digest of the normalised content and the digest of the tokenizer file, so a
text is encoded once for each tokenizer version, however many documents hold it.
"""

from __future__ import annotations

import hashlib
import json
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import cut, dealt_out, utf8

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Units of text whose counts a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
_UNITS_AT_ONCE, _TEXTS_AT_ONCE = 20_000, 64
#: So many digests of texts to encode (64 letters each) are broadcast; more are joined by shuffling.
SENT_DIGESTS = 400_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file, read where the driver runs."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of the content as the tokenizer sees it. The tokenizers here normalise nothing but null to
    empty; a tokenizer with a normaliser of its own gets a digest for each form of a text, which is
    safe."""
    return F.sha2(utf8(text), 256)


def counts_by_word(config: dict) -> bool:
    """Whether a text's count is the sum of the counts of its words, each with the blank before it.

    So it is for byte-level BPE that normalises nothing, adds nothing and cuts with its usual rule,
    which never joins a blank or what follows it to the characters before. No special token may hold
    white space or take it in.
    """
    pre = config.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = config.get("added_tokens") or []
    special = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and len(t["content"].split()) == 1 and t["content"].strip() == t["content"] for t in added)
    return bool(plain and special and not config.get("normalizer") and not config.get("truncation") and not config.get("padding"))


def units_of(text: str) -> list[str]:
    """Cuts a text before each blank that stands between two characters other than white space.

    Joined again they are the text; a run of white space is cut only if it is one blank, and then before it.
    """
    parts = text.split(" ")
    if "" not in parts and not any(map(str.isspace, {p[-1] for p in parts})):
        return [parts[0], *map(" ".__add__, parts[1:])]
    units, open_unit = [], parts[0]
    for part in parts[1:]:
        if open_unit and not open_unit[-1].isspace() and part:
            units.append(open_unit)
            open_unit = " " + part
        else:
            open_unit += " " + part
    return [*units, open_unit] if open_unit else units


class Counter:
    """Token counts by the tokenizers library, for one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = counts_by_word(json.loads(Path(path).read_text()))
        self.known: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self._encode(texts)
        out, known = [], self.known
        for start in range(0, len(texts), _TEXTS_AT_ONCE):
            cuts = [units_of(text) for text in texts[start : start + _TEXTS_AT_ONCE]]
            missing = sorted({u for units in cuts for u in units if u not in known})
            for i in range(0, len(missing), _UNITS_AT_ONCE):
                known.update(zip(some := missing[i : i + _UNITS_AT_ONCE], self._encode(some), strict=True))
            out += [sum(map(known.__getitem__, units)) for units in cuts]
            if len(known) > REMEMBERED:
                known.clear()
        return out


_counters: dict[str, Counter] = {}


def _count_batches(batches, path):
    if path not in _counters:
        _counters[path] = Counter(path)
    for batch in batches:
        counts = _counters[path].count(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])


def read_cache(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) that the cache holds for this tokenizer; nothing where there is no cache yet.

    The cache is stored by tokenizer, so others' counts aren't read. Two jobs may have appended the
    same digest; it is read once.
    """
    spark = docs.sparkSession
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _texts_of_misses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(content, text) of each distinct text whose digest is not in ``known``.

    Digests alone are compared first. Only texts that miss are shuffled, if their digests are few
    enough to be sent to the tasks or nothing is known.
    """
    texts = docs.select(content_digest(F.col("text")).alias("content"), F.coalesce(F.col("text"), F.lit("")).cast("string").alias("text"))
    if not known.isEmpty():
        misses = cut(texts.select("content").distinct().join(known, "content", "left_anti"))
        texts = texts.join(F.broadcast(misses) if misses.count() <= SENT_DIGESTS else misses, "content", "left_semi")
    return texts.groupBy("content").agg(F.first("text").alias("text"))


def fill_cache(docs: DataFrame, tokenizer_path: str, cache: str) -> None:
    """Encodes each distinct text that the cache lacks and appends its count.

    Copies meet in a partial aggregate before the shuffle, so a text that a third of all rows hold
    reaches its task once from each task before. The tokenizer file must be at the same path on the
    executors.
    """
    version = tokenizer_version(tokenizer_path)
    misses = _texts_of_misses(docs, read_cache(docs, cache, version))
    counted = misses.mapInArrow(partial(_count_batches, path=tokenizer_path), "content string, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row for each row of ``docs``.

    Null texts count as empty: no bytes, no tokens. Null and repeated ids keep their rows; other
    columns are ignored. ``cache`` is a folder that all executors share; it is created when missing.
    """
    fill_cache(docs, tokenizer_path, cache)
    data = utf8(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("content"))
    known = read_cache(docs, cache, tokenizer_version(tokenizer_path))
    return rows.join(dealt_out(known), "content").select("doc_id", "n_bytes", "n_tokens")
