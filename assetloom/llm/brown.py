"""Brown class-based bigram language model.

Every training word has a class. The core words, each of which makes up a certain share of the
corpus, are assigned by exchange clustering so that class bigrams explain the corpus best; in it all
other words stand as buckets of their ending. Then each of the others gets the class to which its own
neighbours move it, by the same criterion, in one pass over the corpus. The model's probability of a
word is

    P(class | class before) * P(word | class)

with both smoothed; class bigrams are counted anew with the classes of all words. A word that
training doesn't hold belongs to the class of its ending and is one more word there. Every text starts
after, and closes with, an end token, which is a class of its own.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import partial
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import crc_of_id, stored, utf8

FOLDS, HELD_OUT_FOLD = 5, 1
#: Core words make up at least one in so many of all training tokens, so there are no more of them than that.
CORE_SHARE = 16_384
#: Buckets of endings, and classes.
ENDINGS, CLASSES = 1024, 64
ENDING_LETTERS = 3
ROUNDS = 8
#: A word leaves the class of its ending if that gains so much log likelihood (natural); else a word met once or twice
#: would go wherever its few neighbours happen to point.
LEAST_GAIN = 2.0
#: Distinct other words in a block of documents, which is what is looked up together.
BLOCK_WORDS = 250_000
#: Tokens in a block, a class byte each, which one Python group takes apart.
BLOCK_TOKENS = 4_000_000
#: Distinct keys, and tokens, that a task gathers before it hands them on.
_PENDING, _TOKENS = 200_000, 2_000_000
_ROWS_AT_ONCE = 256
END = 0
#: Marks the class byte of a word that is not core.
_OTHER = 128


def ending(word: bytes) -> int:
    """Bucket of a word's last letters."""
    return zlib.crc32(word.decode(errors="replace")[-ENDING_LETTERS:].encode()) % ENDINGS


class Units(dict):
    """Unit of each word: 0 the end, then the core words, then the buckets of endings.

    Looked-up words are remembered, up to a bound.
    """

    def __init__(self, core: list[bytes]):
        super().__init__({w: i for i, w in enumerate(core, 1)})
        self.core = len(self)

    def __missing__(self, word: bytes) -> int:
        unit = 1 + self.core + ending(word)
        if len(self) < self.core + _PENDING:
            self[word] = unit
        return unit

    def __reduce__(self):
        return Units, ([w for w, i in self.items() if i <= self.core],)


def n_units(core: int) -> int:
    return 1 + core + ENDINGS


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def _slices(batches):
    """Few rows at a time: a batch may hold ten thousand texts, and Python's copies of them come on top."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield batch.slice(start, _ROWS_AT_ONCE)


def _texts(batch, at: int) -> list[bytes]:
    return batch.column(at).to_pylist()


def _word_batches(batches):
    counts: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([w.decode(errors="replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in _slices(batches):
        for raw in _texts(batch, 0):
            counts.update(words_of(raw))
            if len(counts) > _PENDING:
                yield flush()
    yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts (column text, UTF-8), counted in each task before the shuffle."""
    return texts.select("text").mapInArrow(_word_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _units_of(units: Units, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(units.__getitem__, words), dtype=np.int64, count=len(words))


def _bigram_batches(batches, units, size):
    """Counts of unit pairs; each text runs from an end to an end."""
    units, parts, waiting = units.value, [], 0

    def flush():
        codes, counts = np.unique(np.concatenate(parts or [np.zeros(0, np.int64)]), return_counts=True)
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes // size, pa.int32()), pa.array(codes % size, pa.int32()), pa.array(counts, pa.int64())], ["u", "v", "n"])

    for batch in _slices(batches):
        for raw in _texts(batch, 0):
            own = np.concatenate([[END], _units_of(units, words_of(raw)), [END]])
            parts.append(own[:-1] * size + own[1:])
            waiting += len(own)
            if waiting > _TOKENS:
                yield flush()
                waiting = 0
    yield flush()


def _plogp(x):
    return x * np.log(np.maximum(x, 1))


def exchange(right: np.ndarray, left: np.ndarray, own: int, self_n: int, pairs: np.ndarray, total: np.ndarray, came: np.ndarray) -> int:
    """The class to which moving one unit raises the corpus likelihood most, the others staying put.

    right[c], left[c]: how often the unit stands before and after words of class c; pairs: class
    bigrams; total: tokens of each class as left neighbour; came: as right neighbour.
    """
    r, l = right.astype(float), left.astype(float)  # noqa: E741
    # Take the unit out of its own class; self_n counts it next to itself.
    r_out, l_out = r.copy(), l.copy()
    r_out[own] -= self_n
    l_out[own] -= self_n
    base = pairs.astype(float).copy()
    base[own] -= r_out
    base[:, own] -= l_out
    base[own, own] -= self_n
    rows, cols = total.astype(float).copy(), came.astype(float).copy()
    rows[own] -= r.sum()
    cols[own] -= l.sum()
    here = np.diag(base)
    gain = (_plogp(base + r_out[None, :]) - _plogp(base)).sum(axis=1) + (_plogp(base + l_out[:, None]) - _plogp(base)).sum(axis=0)
    # The diagonal cell takes both sides at once.
    gain += _plogp(here + r_out + l_out + self_n) - _plogp(here + r_out) - _plogp(here + l_out) + _plogp(here)
    gain -= _plogp(rows + r.sum()) - _plogp(rows) + _plogp(cols + l.sum()) - _plogp(cols)
    return int(own if gain[own] >= gain.max() - 1e-9 else gain.argmax())


def _exchange_batches(batches, state, classes):
    of_unit, pairs = state.value
    total, came = pairs.sum(axis=1), pairs.sum(axis=0)
    for batch in batches:
        out = []
        for unit, after, before, self_n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            sides = []
            for side in (after, before):
                counts = np.zeros(classes)
                for c, n in side or []:
                    counts[c] += n
                sides.append(counts)
            out.append((unit, exchange(sides[0], sides[1], int(of_unit[unit]), self_n or 0, pairs, total, came)))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int32()), pa.array([c for _, c in out], pa.int32())], ["unit", "to"])


def _likelihood(pairs: np.ndarray) -> float:
    return _plogp(pairs.astype(float)).sum() - _plogp(pairs.sum(axis=1).astype(float)).sum() - _plogp(pairs.sum(axis=0).astype(float)).sum()


def cluster(bigrams: DataFrame, size: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts). The end has a class of its own, 0.

    Units start dealt over the classes by frequency. In a round each unit of one half finds its best
    class with all others fixed, from its counts of neighbouring classes. The halves take turns; moves
    that together lower the likelihood are undone, and two such rounds in a row are the last. The
    driver holds one class for each unit and the table of class bigrams; CORE_SHARE bounds both.
    """
    spark = bigrams.sparkSession
    totals = {r.v: r.n for r in bigrams.groupBy("v").agg(F.sum("n").alias("n")).collect()}
    of_unit = np.zeros(size, dtype=np.int64)
    ordered = sorted((u for u in range(1, size)), key=lambda u: (-totals.get(u, 0), u))
    for place, u in enumerate(ordered):
        of_unit[u] = 1 + place % (classes - 1)

    def class_pairs(assigned):
        table = spark.createDataFrame([(u, int(c)) for u, c in enumerate(assigned)], "unit int, class int")
        left, right = table.toDF("u", "cu"), table.toDF("v", "cv")
        # A row a unit.
        both = bigrams.join(F.broadcast(left), "u").join(F.broadcast(right), "v")
        out = np.zeros((classes, classes), dtype=np.int64)
        for r in both.groupBy("cu", "cv").agg(F.sum("n").alias("n")).collect():
            out[r.cu, r.cv] = r.n
        return both, out

    def moves(both, assigned, pairs, half):
        gather = lambda unit, cls: both.where((F.col(unit) > 0) & (F.col(unit) % 2 == half)).groupBy(F.col(unit).alias("unit"), cls).agg(F.sum("n").alias("n")).groupBy("unit").agg(F.collect_list(F.array(F.col(cls).cast("long"), F.col("n"))).alias(f"by_{unit}"))
        alone = both.where("u = v").select(F.col("u").alias("unit"), F.col("n").alias("self_n"))
        profile = gather("u", "cv").join(gather("v", "cu"), "unit", "full").join(alone, "unit", "left").select("unit", "by_u", "by_v", "self_n")
        state, moved = spark.sparkContext.broadcast((assigned, pairs)), assigned.copy()
        for r in profile.mapInArrow(partial(_exchange_batches, state=state, classes=classes), "unit int, to int").collect():
            moved[r.unit] = max(1, r.to)
        return moved

    (both, pairs), failed = class_pairs(of_unit), 0
    for k in range(rounds):
        moved = moves(both, of_unit, pairs, k % 2)
        new_both, new_pairs = class_pairs(moved)
        if _likelihood(new_pairs) > _likelihood(pairs):
            of_unit, both, pairs, failed = moved, new_both, new_pairs, 0
        else:
            failed += 1
            if failed == 2:
                break
    return of_unit, pairs


class Places(dict):
    """Numbers words, so that each token is looked up once: core words by unit, then the others in the order in which they are first asked for."""

    def __init__(self, units: Units):
        super().__init__((w, i) for w, i in units.items() if i <= units.core)
        self.core, self.units = units.core, array("q", range(units.core + 1))

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.units)
        self.units.append(1 + self.core + ending(word))
        return place

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def unit(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.units, dtype=np.int64)[numbers]

    def others(self) -> list[str]:
        return [w.decode(errors="replace") for w in islice(self, self.core, None)]


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of the given lengths out of consecutive bytes."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes())])


def _profile_batches(batches, state):
    """(word, sides): for each word that is not core, two bytes an occurrence, the classes before and after."""
    units, of_unit = state.value
    places, found, sides, waiting = Places(units), [], [], 0

    def flush():
        nonlocal places
        at = np.concatenate(found or [np.zeros(0, np.int64)])
        around = np.concatenate(sides or [np.zeros((0, 2), np.uint8)])
        order = np.argsort(at, kind="stable")
        words = pa.array(places.others(), pa.string())
        out = pa.RecordBatch.from_arrays([words, _binaries(around[order].reshape(-1), 2 * np.bincount(at, minlength=len(words)))], ["word", "sides"])
        places = Places(units)
        for x in (found, sides):
            x.clear()
        return out

    for batch in _slices(batches):
        for raw in _texts(batch, 0):
            number = places.numbers(words_of(raw))
            classes = np.concatenate([[END], of_unit[places.unit(number)], [END]]).astype(np.uint8)
            at = np.flatnonzero(number > units.core)
            found.append(number[at] - (units.core + 1))
            sides.append(np.stack([classes[at], classes[at + 2]], axis=1))
            waiting += len(at)
            if len(places) - units.core > _PENDING or waiting > _TOKENS:
                yield flush()
                waiting = 0
    yield flush()


def smoothed(pairs: np.ndarray) -> np.ndarray:
    """Natural log of P(class | class before): counts and eight imagined tokens of the classes' shares."""
    came = pairs.sum(axis=0).astype(float)
    prior = (came + 0.5) / (came.sum() + 0.5 * len(pairs))
    return np.log((pairs + 8.0 * prior[None, :]) / (pairs.sum(axis=1)[:, None] + 8.0))


def best_classes(before: np.ndarray, after: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class that each word's neighbours fit best. before, after: a row a word, its counts of neighbouring
    classes; own: the class of its ending, which it leaves for a gain of ``LEAST_GAIN`` only.

    This is what ``exchange`` gains by a move, to first order in the word's count, which is small
    against its class: the mutual information of the word's class bigrams. The end takes no words.
    """
    step, came = smoothed(pairs), pairs.sum(axis=0) + 0.5
    gain = before @ (step - np.log(came / came.sum())[None, :]) + after @ step.T
    gain[:, END] = -np.inf
    gain[np.arange(len(own)), own] += LEAST_GAIN
    return gain.argmax(axis=1)


def _class_batches(batches, pairs, of_ending):
    """(word, n, class) from rows sorted by word. Only the counts of one word are carried from batch to batch."""
    carried, counts = None, np.zeros((1, 2 * CLASSES))

    def rows(words, counts):
        own = of_ending[[ending(w.encode()) for w in words]]
        classes = best_classes(counts[:, :CLASSES], counts[:, CLASSES:], own, pairs)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts[:, :CLASSES].sum(axis=1).astype(np.int64)), pa.array(classes.astype(np.int32))], ["word", "n", "class"])

    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(0).to_pylist()
        new = np.array([a != b for a, b in zip(words, [carried, *words], strict=False)])
        number = np.cumsum(new) + (0 if carried is not None else -1)
        distinct = [*([carried] if carried is not None else []), *compress(words, new.tolist())]
        lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        data = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 2).astype(np.int64)
        owner = np.repeat(number, lengths // 2)
        codes = np.concatenate([owner * 2 * CLASSES + data[:, 0], owner * 2 * CLASSES + CLASSES + data[:, 1]])
        more = np.bincount(codes, minlength=len(distinct) * 2 * CLASSES).reshape(-1, 2 * CLASSES).astype(float)
        if carried is not None:
            more[0] += counts[0]
        if len(distinct) > 1:
            yield rows(distinct[:-1], more[:-1])
        carried, counts = distinct[-1], more[-1:]
    if carried is not None:
        yield rows([carried], counts)


@dataclass
class Model:
    units: Units
    of_unit: np.ndarray
    core_n: np.ndarray  # training count of the end and of each core word, by unit
    tokens_in: np.ndarray  # of each class: training tokens and distinct words
    types_in: np.ndarray
    tokens: int
    types: int

    def emission(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words with the training counts n; the end is the only one in its class."""
        out = np.log10((n + 0.5) / (self.tokens_in + 0.5 * (self.types_in + 1))[of])
        return np.where(of == END, 0.0, out)

    def core_part(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float, float]:
        """(class bytes, whether each token is another word, n_known, base_score, emission) of a text's units without the other words' counts.

        An other word with training count n adds log10(n + 0.5) to the base score, and 1 to n_known if n > 0.
        """
        unit = np.concatenate([unit, [END]])
        of, other = self.of_unit[unit], unit > self.units.core
        n = self.core_n[unit[~other]]
        base = np.log10(n + 0.5).sum() - len(unit) * np.log10(self.tokens + 0.5 * (self.types + 1))
        return (of + _OTHER * other).astype(np.uint8), other, int((n > 0).sum()), float(base), float(self.emission(n, of[~other]).sum())


def fit(train: DataFrame, core_share: int | None = None) -> tuple[Model, DataFrame]:
    """The model of the texts in ``train`` (column text, UTF-8) but for class bigrams, and the table (word, n, class) of all words that are not core.

    Core words make up one in ``core_share`` of all tokens or more (CORE_SHARE unless given); 0 makes every word
    core, for vocabularies that the driver can hold.
    """
    core_share = CORE_SHARE if core_share is None else core_share
    spark = train.sparkSession
    counts = stored(word_counts(train), "brown-words")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    exchanged = F.col("n") * core_share >= (sums.n or 0) if core_share else F.lit(True)
    core = sorted(counts.where(exchanged).collect(), key=lambda r: (-r.n, r.word))
    units = Units([r.word.encode() for r in core])
    size = n_units(len(core))
    sent = spark.sparkContext.broadcast(units)
    bigrams = stored(train.select("text").mapInArrow(partial(_bigram_batches, units=sent, size=size), "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n")), "brown-bigrams")
    of_unit, pairs = cluster(bigrams, size)

    state = spark.sparkContext.broadcast((units, of_unit))
    profiles = train.select("text").mapInArrow(partial(_profile_batches, state=state), "word string, sides binary")
    others = profiles.repartition("word").sortWithinPartitions("word").mapInArrow(partial(_class_batches, pairs=pairs, of_ending=of_unit[-ENDINGS:]), "word string, n long, class int")
    others = stored(others, "brown-others")

    end_n = int(pairs[:, END].sum())
    core_n = np.array([end_n, *(r.n for r in core)], dtype=float)
    tokens_in = np.bincount(of_unit[: len(core_n)], weights=core_n, minlength=CLASSES)
    types_in = np.bincount(of_unit[: len(core_n)], weights=core_n > 0, minlength=CLASSES)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens_in[r["class"]] += r.n
        types_in[r["class"]] += r.v
    return Model(units, of_unit, core_n, tokens_in, types_in, (sums.n or 0) + end_n, sums.v + (end_n > 0)), others


_PREPARED = "block long, words array<string>, doc_id long, n_tokens long, n_known long, base_score double, score double, classes binary, others array<int>"
_PREPARED_ARROW = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.string())), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("classes", pa.binary()), ("others", pa.list_(pa.int32()))])


def _prepare_batches(batches, sent, block_tokens):
    """Documents with the places of their other words in the block's list of words; the list is a row of its own."""
    from pyspark import TaskContext

    model, block, held = sent.value, TaskContext.get().partitionId() << 32, 0
    places = Places(model.units)

    def word_list():
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([places.others()], pa.list_(pa.string())), *(pa.nulls(1, f.type) for f in list(_PREPARED_ARROW)[2:])], schema=_PREPARED_ARROW)

    for batch in _slices(batches):
        rows = []
        for doc_id, raw in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
            number = places.numbers(words_of(raw))
            classes, other, n_known, base, score = model.core_part(places.unit(number))
            at = (number[other[:-1]] - (places.core + 1)).astype(np.int32)
            rows.append((block, None, doc_id, len(number) + 1, n_known, base, score, classes.tobytes(), at))
            held += len(number) + 1
            if len(places) - places.core >= BLOCK_WORDS or held >= block_tokens:
                yield word_list()
                block, places, held = block + 1, Places(model.units), 0
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, _PREPARED_ARROW, strict=True)], schema=_PREPARED_ARROW)
    yield word_list()


_FINISHED = "doc_id long, n_tokens long, n_known long, base_score double, score double, classes binary"


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes one after the other, the values' lengths)."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return data, pc.binary_length(column).to_numpy()


def _finisher(sent):
    """Gives the other words of a block's documents their counts and classes; known: (place, n, class) of those that training holds."""

    def finish_block(docs: pa.Table, known: pa.Table) -> pa.Table:
        model = sent.value
        data, lengths = _bytes_of(docs["classes"])
        data = data.astype(np.int64)
        at = docs["others"].combine_chunks().flatten().to_numpy() if len(docs) else np.zeros(0, np.int64)
        places = known["place"].to_numpy()
        size = int(max(at.max(initial=-1), places.max(initial=-1))) + 1
        count, own = np.zeros(size), np.full(size, -1, dtype=np.int64)
        count[places], own[places] = known["n"].to_numpy(), known["class"].to_numpy()
        other = np.flatnonzero(data >= _OTHER)
        data[other] -= _OTHER
        n = count[at]
        data[other] = np.where(own[at] < 0, data[other], own[at])
        doc = np.repeat(np.arange(len(docs)), lengths)[other]
        sums = lambda x: np.bincount(doc, weights=x, minlength=len(docs))
        add = lambda name, x: pa.array(docs[name].to_numpy() + x)
        return pa.table(
            [docs["doc_id"], docs["n_tokens"], add("n_known", sums(n > 0).astype(np.int64)), add("base_score", sums(np.log10(n + 0.5))), add("score", sums(model.emission(n, data[other]))), _binaries(data, lengths)],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score", "classes"],
        )

    return finish_block


def _steps(column) -> tuple[np.ndarray, np.ndarray]:
    """(class before * CLASSES + class of each token, its text's number); each text starts after an end."""
    data, lengths = _bytes_of(pa.chunked_array([column]))
    before = np.concatenate([[END], data[:-1]])[: len(data)].astype(np.int64)
    before[np.cumsum(lengths)[:-1]] = END  # every text has its end, so none is empty
    return before * CLASSES + data, np.repeat(np.arange(len(lengths)), lengths)


def _step_batches(batches):
    counts = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            counts += np.bincount(_steps(batch.column(0))[0], minlength=len(counts))
    met = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(counts[met])], ["step", "n"])


def _score_batches(batches, step):
    step = step.reshape(-1)
    for batch in batches:
        if not batch.num_rows:
            continue
        code, doc = _steps(batch.column(5))
        total = batch.column(4).to_numpy() + np.bincount(doc, weights=step[code], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(total)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, core_share: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    The model learns from the documents whose crc32(doc_id as text) mod 5 is not 1. Null texts count
    as empty: one token, the end. Null ids count as the empty text in the rule for held-out rows;
    repeated rows count and are scored as often as they occur; other columns are ignored. Without
    training rows all probabilities come from the smoothing alone.

    Exchange clustering moves the words that make up one in ``core_share`` of the training tokens (see ``fit``), 0 all
    of them; every other training word is put in the class to which its neighbours move it.

    A task reads its documents' core words by itself and lists the other words of each block of
    documents. The lists meet the table of all other words in a join and return to their blocks, so no
    task ever holds the whole vocabulary and no text is shuffled: a document goes on as one byte a
    token, its class. From these the class bigrams are counted and the scores summed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text").cast("string")).alias("text"))
    held_out = crc_of_id(F.col("doc_id")) % FOLDS == HELD_OUT_FOLD
    model, others = fit(rows.where(~held_out), core_share)
    sent = spark.sparkContext.broadcast(model)
    prepared = stored(rows.mapInArrow(partial(_prepare_batches, sent=sent, block_tokens=BLOCK_TOKENS), _PREPARED), "brown-blocks")
    asked = prepared.where("words is not null").select("block", F.posexplode("words").alias("place", "word"))
    known = asked.join(others, "word").select(F.col("block").alias("of_block"), "place", "n", "class")
    blocks = prepared.where("words is null").drop("words")
    finished = stored(blocks.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_finisher(sent), _FINISHED), "brown-classes")

    pairs = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for r in finished.where(~held_out).select("classes").mapInArrow(_step_batches, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        pairs[r.step] = r.n
    step = smoothed(pairs.reshape(CLASSES, CLASSES)) / np.log(10)
    scored = finished.mapInArrow(partial(_score_batches, step=step), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
