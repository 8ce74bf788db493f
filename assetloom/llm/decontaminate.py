"""Benchmark decontamination: linked word pairs as seeds, then Smith-Waterman alignment of the passages.

Words are compared with A-Z lower-cased and ASCII punctuation removed. A link is a pair of words that
are neighbours, or next but one, in the item and in the document (in either, so that one word may be
replaced, added or left out between them). An alignment that reaches the threshold has links from a
least number of the item's places, so of the places with the rarest pairs just so many are looked up
that none of these alignments can do without all of them. Where a document holds such a link, the
passage around it is aligned with the item word by word. The results are those of aligning every
document with every item; how often a pair occurs decides only what the search costs.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import word_count

#: Items of fewer words can't be told from chance and are left out.
LEAST_WORDS = 3
#: Share of the best alignment score (an exact copy) from which a passage counts as a copy.
THRESHOLD = 0.5
#: The bounds of ``links_needed`` and ``_slack`` follow from these scores.
MATCH, MISMATCH, GAP = 2, -1, -1
#: The index of so many item words is sent to the tasks at once; a larger benchmark takes more passes.
WORDS_PER_PASS = 1_000_000
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_PUNCTUATION = string.punctuation.encode()


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER, _PUNCTUATION).split()


def links_needed(words: int, threshold: float) -> int:
    """Places of an item from which links start in each alignment that reaches the threshold, at least.

    With M matched words and e words replaced, added or left out between them, the score is 2 M - e or
    less, so e <= 2 M - 2 threshold words. Of the M - 1 steps from a match to the next, those with two
    or more such words are no links; they are e / 2 at most, which leaves threshold words - 1.
    """
    return math.ceil(threshold * words - 1 - 1e-9)


def _slack(words: int, threshold: float) -> int:
    """Most words that a copy can have besides the item's: its matches pay for no more."""
    return math.floor((2 - 2 * threshold) * words + 1e-9)


@dataclass
class Index:
    """codes: the word pairs, sorted. Pair i starts at places[first[i]:first[i + 1]] of the items owners[...]."""

    vocabulary: dict[bytes, int]
    items: dict[int, np.ndarray]
    codes: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, items: dict[int, bytes]) -> Index:
        split = {k: words for k, raw in sorted(items.items()) if len(words := words_of(raw)) >= LEAST_WORDS}
        vocabulary = {w: i for i, w in enumerate(sorted({w for words in split.values() for w in words}), 1)}
        ids = {k: np.array([vocabulary[w] for w in words], dtype=np.int64) for k, words in split.items()}
        rows = [(code, np.full(len(code), k, np.int64), np.arange(len(code))) for k, x in ids.items() for code in _pairs(x, len(vocabulary))]
        codes, owners, places = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 3
        return cls._sorted(vocabulary, ids, codes, owners, places)

    @classmethod
    def _sorted(cls, vocabulary, items, codes, owners, places) -> Index:
        order = np.lexsort((places, owners, codes))
        codes, first = np.unique(codes[order], return_index=True)
        return cls(vocabulary, items, codes, np.append(first, len(order)), owners[order], places[order])

    def rarest(self, counts: np.ndarray, threshold: float) -> Index:
        """Each item keeps its places with the rarest pairs, as few as no alignment at the threshold can avoid."""
        seeds = np.repeat(np.arange(len(self.codes)), np.diff(self.first))
        names = np.array(list(self.items), dtype=np.int64)
        start = np.concatenate([[0], np.cumsum([len(x) - 1 for x in self.items.values()])]).astype(np.int64)
        where = start[np.searchsorted(names, self.owners)] + self.places
        total = np.bincount(where, weights=counts[seeds], minlength=start[-1])
        kept = np.zeros(start[-1], dtype=bool)
        for at, words in zip(start.tolist(), map(len, self.items.values()), strict=False):
            kept[at + np.argsort(total[at : at + words - 1], kind="stable")[: words - links_needed(words, threshold)]] = True
        kept = kept[where]
        return self._sorted(self.vocabulary, self.items, self.codes[seeds[kept]], self.owners[kept], self.places[kept])

    def ids_of(self, raw: bytes) -> np.ndarray:
        """The document's words as ids; words that no item has are 0."""
        words = words_of(raw)
        return np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), dtype=np.int64, count=len(words))

    def seeds_in(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seed numbers) of the pairs in a document."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known, found = ids > 0, []
        for step, codes in enumerate(_pairs(ids, len(self.vocabulary)), 1):
            at = np.flatnonzero(known[:-step] & known[step:])
            codes = codes[at]
            seed = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = self.codes[seed] == codes
            found.append((at[hit], seed[hit]))
        at, seed = zip(*found, strict=True)
        return np.concatenate(at), np.concatenate(seed)

    def starts_in(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item_id, sorted places where the item would start) for the items with links in a document."""
        at, seed = self.seeds_in(ids)
        if not len(at):
            return []
        many = self.first[seed + 1] - self.first[seed]
        post = np.repeat(self.first[seed] - np.cumsum(many) + many, many) + np.arange(many.sum())
        owners, starts = self.owners[post], np.repeat(at, many) - self.places[post]
        order = np.lexsort((starts, owners))
        owners, starts = owners[order], starts[order]
        names, first = np.unique(owners, return_index=True)
        return list(zip(names.tolist(), np.split(starts, first[1:]), strict=True))


def _pairs(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of neighbours, and of words next but one to each other."""
    size = words + 1
    return ids[:-1] * size + ids[1:], ids[:-2] * size + ids[2:]


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two id sequences, and the passage's place where it ends."""
    place = np.arange(len(passage))
    row, best, end = np.zeros(len(passage), dtype=np.int64), 0, 0
    for word in item:
        diagonal = np.concatenate([[0], row[:-1]]) + np.where(passage == word, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum.accumulate(row - GAP * place) + GAP * place
        if (top := int(row.argmax())) >= 0 and row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _windows(starts: np.ndarray, length: int, slack: int) -> list[tuple[int, int]]:
    """Stretches around the sorted places where copies of an item would start; overlapping ones are joined."""
    gaps = np.flatnonzero(np.diff(starts) > length + 2 * slack)
    lows, highs = starts[np.append(0, gaps + 1)] - slack, starts[np.append(gaps, -1)] + length + slack
    return list(zip(np.maximum(lows, 0).tolist(), highs.tolist(), strict=True))


def _may_hold(words: np.ndarray, passage: np.ndarray, threshold: float) -> bool:
    """Whether enough of the item's words lie as close together in the passage as in a copy."""
    need = math.ceil(threshold * len(words) - 1e-9)
    sums = np.concatenate([[0], np.cumsum(np.isin(passage, words))])
    span = min(len(words) + _slack(len(words), threshold), len(passage))
    return (sums[span:] - sums[: len(sums) - span]).max() >= need and np.isin(words, passage).sum() >= need


def copies_in(index: Index, raw: bytes, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item_id, score, links met, last word's place) for each item of which the text holds a copy."""
    ids = index.ids_of(raw)
    out = []
    for item, starts in index.starts_in(ids):
        words = index.items[item]
        best, end = 0, 0
        for lo, hi in _windows(starts, len(words), _slack(len(words), threshold)):
            passage = ids[lo:hi]
            if _may_hold(words, passage, threshold):
                score, place = alignment(words, passage)
                if score > best:
                    best, end = score, lo + place
        if best >= threshold * MATCH * len(words):
            out.append((item, best / (MATCH * len(words)), len(starts), end))
    return out


def _raw(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _count_batches(batches, index):
    index = index.value
    counts = np.zeros(len(index.codes), dtype=np.int64)
    for batch in batches:
        for raw in _raw(batch.column(0)):
            counts[np.unique(index.seeds_in(index.ids_of(raw))[1])] += 1
    met = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(counts[met], pa.int64())], ["seed", "n"])


def _copy_batches(batches, index, threshold):
    for batch in batches:
        rows = [(doc, *x) for doc, raw in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), strict=True) for x in copies_in(index.value, raw, threshold)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "seeds", "last_word"])


def _clean_batches(batches, index, place, threshold):
    for batch in batches:
        yield batch.filter(pa.array([not copies_in(index.value, x, threshold) for x in _raw(batch.column(place))], pa.bool_()))


def _passes(one: DataFrame) -> list[tuple[int, int]]:
    """Ranges of item ids, both ends included, of at most WORDS_PER_PASS words or of one item.

    Only item ids and lengths reach the driver, a few bytes an item.
    """
    out, held = [], 0
    for r in sorted(one.select("item_id", word_count(F.col("text")).alias("n")).toLocalIterator()):
        if not out or held + r.n > WORDS_PER_PASS:
            out.append((r.item_id, r.item_id))
            held = 0
        out[-1], held = (out[-1][0], r.item_id), held + r.n
    return out or [(0, 0)]


def indexes(docs: DataFrame, benchmark: DataFrame, threshold: float):
    """The indexes of the rarest links of the benchmark, one for each pass (see ``_passes``).

    Items with null text or id are left out; an id that repeats keeps its least text.
    """
    if not 1 < threshold * LEAST_WORDS <= LEAST_WORDS:
        raise ValueError(f"threshold {threshold}: a copy of {LEAST_WORDS} words needs more than one of them, so more than 1 / {LEAST_WORDS}, and 1 at most")
    one = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    context = docs.sparkSession.sparkContext
    for low, high in _passes(one):
        rows = one.where(F.col("item_id").between(low, high)).collect()
        index = Index.of({r.item_id: r.text.encode() for r in rows})
        sent = context.broadcast(index)
        counted = docs.select(F.col("text").cast("string")).mapInArrow(partial(_count_batches, index=sent), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(index.codes), dtype=np.int64)
        for r in counted:
            counts[r.seed] = r.n
        yield context.broadcast(index.rarest(counts, threshold))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, seeds, last_word) for each document row and item of which it holds a copy.

    score is the alignment's share of an exact copy's. Null or empty texts and an empty benchmark
    give no rows; repeated documents give repeated rows; other columns are ignored. Items of fewer than
    LEAST_WORDS words aren't looked for: they would be found in any text that holds those words.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, seeds long, last_word long"
    out = None
    for index in indexes(docs, benchmark, threshold):
        found = texts.mapInArrow(partial(_copy_batches, index=index, threshold=threshold), schema)
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that hold no copy of a benchmark item.

    Null and empty texts stay, equal rows go or stay together, an empty benchmark keeps all rows and an
    empty table none. Items of fewer than LEAST_WORDS words aren't looked for.
    """
    for index in indexes(docs, benchmark, threshold):
        docs = docs.mapInArrow(partial(_clean_batches, index=index, place=docs.columns.index("text"), threshold=threshold), docs.schema)
    return docs
