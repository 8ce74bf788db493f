"""Links between the tokens of two tokenizers, weighted by how often the corpus links them.

A batch of texts is one run of bytes. The tokens' ends are cumulative sums of their byte lengths,
offsets where tokens of both end are the intersection, and a token's group is the place of its end
among those cuts. Links join the tokens that end at one cut, and are laid out by repeating each A token
as often as B tokens end there.

Texts are cut into units, a word with the blank before it, where neither tokenizer joins what stands on
both sides (checked with the files; else a text is one unit). A worker remembers units' tokens, groups and links,
bounded, so a frequent word is encoded once. A text with a unit whose tokens don't give its bytes back
is encoded whole, as defined.

A linked pair's tokens end together over the same bytes, so one is a suffix of the other. A token of k
bytes has k suffixes, and few ids share their bytes, so pairs are bounded by the vocabularies whatever the corpus
(``most_pairs``); their counts may be sent to all tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from functools import cache, partial
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import stored
from assetloom.llm.tokencount import counts_by_word, units_of

BLANK = "▁"
SALTS = 16
#: Units that a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
_TEXTS_AT_ONCE, _UNITS_AT_ONCE = 64, 20_000
_SHIFT = 32
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file; special tokens stand for none."""
    config, letters = json.loads(Path(path).read_text()), _byte_of_letter()
    special = {t["id"] for t in config.get("added_tokens") or []}
    out = [b""] * (1 + max(config["model"]["vocab"].values()))
    for piece, i in config["model"]["vocab"].items():
        if i not in special:
            out[i] = bytes(letters[c] for c in piece)
    return out


def bytes_of_b(model) -> list[bytes]:
    """The bytes of each id of a piece model."""

    def of(i):
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:5], 16)])
        return b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace(BLANK, " ").encode()

    return [of(i) for i in range(model.get_piece_size())]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can be linked: those of which one's bytes end the other's."""

    def within(longer, shorter, whole):
        known = Counter(shorter)
        return sum(known[t[i:]] for t in longer if t for i in range(0 if whole else 1, len(t)))

    return within(a, b, True) + within(b, a, False)


class Aligner:
    """Both tokenizers and the units that a worker remembers.

    A unit has a number. By number there are its counts (na, nb, ng), its groups as text, and where its
    links begin and end in ``links``.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes, b_bytes = bytes_of_a(a_path), bytes_of_b(self.b)
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self.a_length, self.b_length = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a_bytes, b_bytes))
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.first_b = 2 * len(a_bytes)
        self.written = np.array([f"{i}{sign}" for n, signs in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for i in range(n) for sign in signs], object)
        self.by_unit = counts_by_word(json.loads(Path(a_path).read_text())) and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.empty((0, 3), np.int64)
        self.link_ends, self.links = np.zeros(1, np.int64), np.empty(0, np.int64)

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text, which begins with a blank: whether its bytes come back; counts of tokens of A, of B, and
        of groups; the groups; the ends of its links in the last array, and all texts' links."""
        whole = [t.encode() for t in texts]
        sides = [[e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)]
        flat, sizes = self._flat(sides)
        good = self._gives_back(whole, sides, flat, sizes)
        if not good.all():
            flat, sizes = self._flat([[ids if g else [] for ids, g in zip(side, good, strict=True)] for side in sides])
        a, b = flat
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        cuts = np.intersect1d(a_end, b_end)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        # Tokens that end at a cut, and for each such A token the B tokens that end there too.
        a_last, b_last = np.flatnonzero(a_end == cuts[a_group]), np.flatnonzero(b_end == cuts[b_group])
        first, beyond = (np.searchsorted(b_group[b_last], a_group[a_last], side) for side in ("left", "right"))
        each = beyond - first
        partner = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
        links = np.repeat(a[a_last], each) << _SHIFT | b[b_last[partner]]
        # The texts' shares: a text's last token ends its last group.
        text_of = np.repeat(np.arange(len(texts)), sizes[:, 0])
        link_counts = np.bincount(np.repeat(text_of[a_last], each), minlength=len(texts))
        begins = np.diff(a_group, prepend=-1) > 0
        group_counts = np.bincount(text_of[begins], minlength=len(texts))
        # As text: a group's A tokens, then its B tokens, each with the sign that follows it.
        ends_group = [np.diff(of, append=len(cuts)) > 0 for of in (a_group, b_group)]
        signed = np.concatenate([2 * a + ends_group[0], self.first_b + 2 * b + ends_group[1]])
        parts = self.written[signed[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")]].tolist()
        ends = np.cumsum(np.r_[0, sizes.sum(1)]).tolist()
        groups = ["".join(parts[i:j])[:-1] for i, j in pairwise(ends)]
        return good, np.c_[sizes, group_counts], groups, np.cumsum(link_counts), links

    @staticmethod
    def _flat(sides: list[list[list[int]]]) -> tuple[list[np.ndarray], np.ndarray]:
        """All ids of each side, and how many each text has of either."""
        sizes = np.array([list(map(len, side)) for side in sides], np.int64).T.reshape(-1, 2)
        return [np.fromiter(chain.from_iterable(side), np.int64, n) for side, n in zip(sides, sizes.sum(0), strict=True)], sizes

    def _gives_back(self, whole: list[bytes], sides, flat, sizes) -> np.ndarray:
        """Which texts both tokenizers' bytes are equal to. All at once if all are, else one by one."""
        good, lengths = np.ones(len(whole), bool), np.fromiter(map(len, whole), np.int64, len(whole))
        for k, (known, length) in enumerate(((self.a_bytes, self.a_length), (self.b_bytes, self.b_length))):
            ends = np.r_[0, np.cumsum(length[flat[k]])][np.cumsum(sizes[:, k])]
            if (ends != np.cumsum(lengths)).any() or b"".join(map(known.__getitem__, chain.from_iterable(sides[k]))) != b"".join(whole):
                good &= np.array([b"".join([known[i] for i in ids]) == t for ids, t in zip(sides[k], whole, strict=True)], bool)
        return good

    def _learn(self, units: list[str]) -> None:
        good, counts, groups, ends, links = self.align(units)
        counts[~good] = -1
        self.number.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.groups += groups
        self.counts = np.r_[self.counts, counts]
        self.link_ends = np.r_[self.link_ends, self.link_ends[-1] + ends]
        self.links = np.r_[self.links, links]

    def rows(self, texts: list[str]):
        """(n_a, n_b, n_groups, groups, links) of each text; texts that don't come back have nothing."""
        for start in range(0, len(texts), _TEXTS_AT_ONCE):
            some = texts[start : start + _TEXTS_AT_ONCE]
            cuts = [units_of(" " + t) if self.by_unit and t else [" " + t] if t else [] for t in some]
            missing = sorted({u for units in cuts for u in units if u not in self.number})
            for i in range(0, len(missing), _UNITS_AT_ONCE):
                self._learn(missing[i : i + _UNITS_AT_ONCE])
            for text, units in zip(some, cuts, strict=True):
                yield self._row(text, units)
            if len(self.number) > REMEMBERED:
                self.forget()

    def _row(self, text: str, units: list[str]):
        at = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        counts = self.counts[at].reshape(-1, 3)
        if len(units) > 1 and (counts < 0).any():
            good, counts, groups, _, links = self.align([" " + text])
            return (*counts[0], groups[0], links) if good[0] else (0, 0, 0, "", links[:0])
        if not units or (counts < 0).any():
            return 0, 0, 0, "", self.links[:0]
        first, n = self.link_ends[at], self.link_ends[at + 1] - self.link_ends[at]
        place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return (*counts.sum(0), ";".join(map(self.groups.__getitem__, at.tolist())), self.links[place])


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _link_batches(batches, a_path, b_path):
    aligner, schema = _aligner(a_path, b_path), pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
    for batch in batches:
        for start in range(0, len(batch), _TEXTS_AT_ONCE):
            part = batch.slice(start, _TEXTS_AT_ONCE)
            out = []
            for n_a, n_b, n_groups, groups, links in aligner.rows([t or "" for t in part.column(1).to_pylist()]):
                pairs, times = np.unique(links, return_counts=True)
                out.append((n_a, n_b, n_groups, len(links), hashlib.sha256(groups.encode()).hexdigest() if groups else "", pairs, times))
            columns = [pa.array(list(c)) for c in zip(*[r[:5] for r in out], strict=True)]
            ends = pa.array(np.cumsum([0, *[len(r[5]) for r in out]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in out]).astype(kind))) for k, kind in ((5, np.int64), (6, np.int32))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, *lists], schema=schema)


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, the counts and groups of each text, and its distinct pairs (A id << 32 | B id) with how often each is linked."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_link_batches, a_path=a_path, b_path=b_path), LINKED)


def pair_counts(linked_rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, count, best): each pair's links in the corpus, and whether no pair of its B id has more.

    A pair reaches its salted group once from each task, and its total once from each salt.
    """
    each = linked_rows.withColumn("salt", F.spark_partition_id() % salts).select("salt", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    salted = each.select("salt", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("n")).groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy((F.col("pair").bitwiseAND((1 << _SHIFT) - 1)).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.col("pair").bitwiseAND((1 << _SHIFT) - 1)).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _weigh_batches(batches, sent):
    pairs, counts, best = sent.value
    for batch in batches:
        held, times = batch.column("pairs"), batch.column("times")
        ends = held.offsets.to_numpy() - held.offsets[0].as_py()
        at, n = np.searchsorted(pairs, held.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
        added = lambda v: np.diff(np.r_[0, np.cumsum(v)][ends])
        sums = [pa.array(added(v), pa.int64()) for v in (n * best[at], n * counts[at])]
        kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        yield pa.RecordBatch.from_arrays([*kept, *sums, batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``.

    Null and empty texts, and texts that a tokenizer doesn't give back, have no tokens: zeros and ''.
    Null and repeated ids keep their rows; repeated texts count once for each row; ties for a B id's
    highest count are all best. Columns other than ``doc_id`` and ``text`` are ignored. The files must be at the
    same paths on the executors.
    """
    rows = stored(linked(docs, a_path, b_path), "token-links")
    # Bounded by the vocabularies, see above.
    table = pair_counts(rows).orderBy("pair").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["count"].to_numpy(), table["best"].to_numpy().astype(np.int64)))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.mapInArrow(partial(_weigh_batches, sent=sent), schema)
