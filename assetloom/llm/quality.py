"""Naive-Bayes support vectors: a linear hinge-loss quality model over scaled n-gram indicators.

A text has three families of indicators: its bytes (n-grams of 1 to 4, A-Z lower-cased), its words
(single words and pairs, and lines that occur again) and its shape (n-grams of character classes with
runs collapsed, and of whether a word repeats the one before). Each indicator is scaled by the log
ratio of the class counts, each family to length one, and a linear model is fitted to them by dual
coordinate descent.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import crc_of_id

#: The model is fitted on at most this many labelled rows, those with the least hash of their id.
SAMPLE_ROWS = 3_000
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0
#: One row in so many of the sample is kept from the first fit, to turn margins into probabilities.
CALIBRATION = 4
_LONGEST = 4
_REPEATS = 1 << (_LONGEST + 1)
#: Hashed slots of each kind of indicator, and where the slots of each family start.
_BYTE_BITS, _WORD_BITS, _LINE_SLOTS, _SHAPE_BITS = 15, 16, 8, 14
_WORDS = 1 << _BYTE_BITS
_LINES = _WORDS + (1 << _WORD_BITS)
_SHAPES = _LINES + _LINE_SLOTS
SIZE = _SHAPES + (1 << _SHAPE_BITS) + _REPEATS
FAMILIES = (0, _WORDS, _SHAPES, SIZE)
_ODD = np.uint32(2654435761)


def _character_classes() -> np.ndarray:
    """A class below 64 for each byte: white space, lower, upper, digit, beyond ASCII, or its own."""
    classes = np.full(256, 4, dtype=np.uint32)
    own = iter(range(6, 64))
    for b in range(128):
        c = chr(b)
        classes[b] = 0 if c.isspace() else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else next(own) if b > 32 and b < 127 else 5
    return classes


_CLASSES = _character_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _ngram_slots(symbols: np.ndarray, width: int, bits: int, start: int, flags: np.ndarray) -> None:
    code = symbols
    for n in range(1, _LONGEST + 1):
        if len(symbols) < n:
            return
        if n > 1:
            code = (code[:-1] << np.uint32(width)) | symbols[n - 1 :]
        flags[start + (((code ^ np.uint32(n << 29)) * _ODD) >> np.uint32(32 - bits)).astype(np.int64)] = True


def _repeat_slots(same: np.ndarray, flags: np.ndarray) -> None:
    code = same
    for n in range(1, _LONGEST + 1):
        if len(same) < n:
            return
        if n > 1:
            code = code[:-1] * 2 + same[n - 1 :]
        flags[_SHAPES + (1 << _SHAPE_BITS) + (1 << n) + code] = True


def _word_slots(words: list[bytes], flags: np.ndarray) -> None:
    """Single words and pairs of neighbours."""
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    for code in (h, (h[:-1] * np.uint32(31) + h[1:]) ^ np.uint32(1 << 31)):
        flags[_WORDS + ((code * _ODD) >> np.uint32(32 - _WORD_BITS)).astype(np.int64)] = True


def _line_slot(raw: bytes, flags: np.ndarray) -> None:
    """Which share of the lines and sentences stood in the text before, in eighths; none if none did."""
    lines = [x for line in raw.replace(b". ", b"\n").split(b"\n") if (x := line.strip())]
    again = len(lines) - len(set(lines))
    if again:
        flags[_LINES + min(_LINE_SLOTS * again // len(lines), _LINE_SLOTS - 1)] = True


def features(raw: bytes, flags: np.ndarray) -> np.ndarray:
    """Sorted slots of the indicators that the whole text has. flags: SIZE booleans, all false before and after."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data):
        _ngram_slots(_LOWER[data].astype(np.uint32), 8, _BYTE_BITS, 0, flags)
        classes = _CLASSES[data]
        _ngram_slots(classes[np.flatnonzero(np.diff(classes, prepend=np.uint32(255)))], 6, _SHAPE_BITS, _SHAPES, flags)
    words = raw.split()
    if words:
        _word_slots(raw.lower().split(), flags)
        _line_slot(raw, flags)
    if len(words) > 1:
        _repeat_slots(np.fromiter(map(bytes.__eq__, words, words[1:]), dtype=np.int64, count=len(words) - 1), flags)
    found = np.flatnonzero(flags)
    flags[found] = False
    return found.astype(np.int32)


def _parts(found: np.ndarray) -> list[np.ndarray]:
    return np.split(found, np.searchsorted(found, FAMILIES[1:-1]))


def _scaled(found: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The ratios of a text's indicators, each family to length one."""
    parts = [ratio[x] for x in _parts(found)]
    return np.concatenate([v / np.sqrt((v * v).sum() + 1e-12) for v in parts])


@dataclass
class Model:
    """Score of a text: logistic(slope * margin + shift), margin = bias + the scaled ratios times the weights."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return self.bias + float(self.weight[found] @ _scaled(found, self.ratio))

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -35, 35))))


def _log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    good, bad = np.ones(SIZE), np.ones(SIZE)
    for x, k in zip(rows, y, strict=True):
        np.add.at(good if k == 1 else bad, x, 1)
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def _dual_coordinate_descent(rows, values, y, size, cost=1.0, rounds=12, seed=7):
    """Minimises |w|^2 / 2 + cost * sum of hinge losses; the last weight is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    square = np.array([(v * v).sum() + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * ((w[rows[i]] * values[i]).sum() + w[size]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if step := (new - alpha[i]) * y[i]:
                worst = max(worst, abs(step))
                w[rows[i]] += step * values[i]
                w[size] += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([margin, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        b = b + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * b)
    return float(b[0]), float(b[1])


def _linear(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio = _log_count_ratios(rows, y)
    # One array for all values: thousands of small ones would leave the driver's memory in pieces.
    values = np.split(np.empty(sum(map(len, rows)), np.float32), np.cumsum([len(x) for x in rows])[:-1])
    for x, own in zip(rows, values, strict=True):
        own[:] = _scaled(x, ratio)
    w = _dual_coordinate_descent(rows, values, y, SIZE)
    return Model(w[:SIZE], ratio, float(w[SIZE]), 1.0, 0.0)


def fit_model(rows: list[np.ndarray], labels: list[int]) -> Model:
    """With one class or no rows the model gives every text the smoothed share of label 1.

    The logistic curve is fitted to margins of rows that the fit for it hasn't seen, one in
    ``CALIBRATION`` (to all rows where those or the others hold one class only); then all rows are fitted.
    """
    y = np.where(np.array(labels, dtype=int) == 1, 1, -1)
    if len({*y.tolist()}) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    model = _linear(rows, y)
    unseen = np.arange(len(y)) % CALIBRATION == 0
    first, judged = model, ~unseen | unseen
    if all(len({*y[x].tolist()}) == 2 for x in (unseen, ~unseen)):
        first, judged = _linear([x for x, u in zip(rows, unseen, strict=True) if not u], y[~unseen]), unseen
    margin = np.array([first.margin(rows[i]) for i in np.flatnonzero(judged)])
    model.slope, model.shift = _platt(margin, y[judged])
    return model


def _raw(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _feature_batches(batches):
    flags = np.zeros(SIZE, dtype=bool)
    for batch in batches:
        found = [features(x, flags).tobytes() for x in _raw(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "quality", "found"])


def training_labels(labels: DataFrame, held_out_fold: int | None = HELD_OUT_FOLD) -> DataFrame:
    """(doc_id, quality) of the bounded sample. Rows with null id or label are left out; an id with several labels takes the commonest, ties the smaller."""
    known = labels.where("doc_id is not null and quality in (0, 1)")
    if held_out_fold is not None:
        known = known.where(crc_of_id(F.col("doc_id")) % FOLDS != held_out_fold)
    one = known.groupBy("doc_id").agg((2 * F.sum("quality") > F.count("*")).cast("int").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most ``SAMPLE_ROWS`` labelled rows; that bound lets the label side be broadcast.

    An id that repeats among the documents is used once (the text with the least indicators in byte
    order), so at most ``SAMPLE_ROWS`` rows reach the driver. They are put in the order of their ids,
    so the same tables give the same model.
    """
    sample = training_labels(labels)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    found = texts.mapInArrow(_feature_batches, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, quality int, found binary")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("found", "quality")).alias("one")).select("doc_id", "one.*").toArrow().sort_by("doc_id")
    model = fit_model([np.frombuffer(x.as_buffer(), dtype=np.int32) for x in rows["found"]], rows["quality"].to_pylist())
    del rows
    pa.default_memory_pool().release_unused()  # else the sample stays the driver's
    return model


def _score_batches(batches, model):
    model, flags = model.value, np.zeros(SIZE, dtype=bool)
    for batch in batches:
        scores = [model.score(features(x, flags)) for x in _raw(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double), one row for each row of ``docs``.

    Null texts count as empty; an empty text gets the score of no n-grams. Other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_score_batches, model=shared), "doc_id long, score double")


def _kept_batches(batches, model, place, threshold):
    model, flags = model.value, np.zeros(SIZE, dtype=bool)
    for batch in batches:
        yield batch.filter(pa.array([model.score(features(x, flags)) >= threshold for x in _raw(batch.column(place))], pa.bool_()))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_kept_batches, model=shared, place=docs.columns.index("text"), threshold=threshold), docs.schema)
