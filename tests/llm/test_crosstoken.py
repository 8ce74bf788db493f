"""Token links against a plain version that encodes every text whole."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetloom.llm import crosstoken, registry

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def aligner():
    return crosstoken.Aligner(A, B)


def whole(text, aligner):
    """Ids of both sides with their ends, or nothing."""
    if not text:
        return [], []
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    sides = []
    for ids, known in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        at, ends = 0, []
        for i in ids:
            at += len(known[i])
            ends.append((i, at))
        if b"".join(known[i] for i in ids) != (" " + text).encode():
            return [], []
        sides.append(ends)
    return sides


def plain(rows, aligner):
    """rows: (doc_id, text). The query's rows, by comparing the tokens one by one."""
    total, each = Counter(), []
    for doc_id, text in rows:
        a, b = whole(text, aligner)
        common = sorted({e for _, e in a} & {e for _, e in b})
        groups, begin = [], 0
        for cut in common:
            groups.append("|".join(",".join(str(i) for i, e in side if begin < e <= cut) for side in (a, b)))
            begin = cut
        ends = {}
        for i, e in b:
            ends.setdefault(e, []).append(i)
        links = [(i, j) for i, e in a for j in ends.get(e, [])]
        total.update(links)
        each.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    return [(d, a, b, g, len(x), sum(total[p] == most[p[1]] for p in x), sum(total[p] for p in x), digest) for d, a, b, g, x, digest in each]


def same(docs, aligner, got=None):
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], aligner)
    got = (got or crosstoken.align(docs, A, B)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["tricky", "no_rows"])
def test_links(request, aligner, name):
    same(request.getfixturevalue(name), aligner)


def test_query(spark, small, corpus, aligner):
    got = registry.QUERIES["op11_cross_tokens"](spark, small)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(corpus, aligner, got)


def test_very_long_words_and_many_copies(spark, aligner):
    texts = ["x" * 20_000, "é" * 3000, " " * 500, "ab " * 3000, "\U0001f600" * 400, "‍́ 　 x", "\x1c \x85y   z", "퟿ ﻿"]
    same(spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["copy text"] * 300)], "doc_id long, text string"), aligner)


LETTERS = st.sampled_from([*" \n\t\r\x0b\x1c\x85  　▁", *"aeéxZ09.,'<>|_-", "the", " and", "'s", "<s>", "<|endoftext|>", "<0x41>", "́", "日本", "😀"])


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(LETTERS, max_size=12).map("".join), min_size=1, max_size=6))
def test_units_are_whole_texts(aligner, texts):
    """Unit by unit and remembered, as encoded whole."""
    got = [(a, b, g, groups, sorted(links.tolist())) for a, b, g, groups, links in aligner.rows(texts)]
    for text, row in zip(texts, got, strict=True):
        if not text:
            assert row == (0, 0, 0, "", [])
            continue
        good, counts, groups, _, links = aligner.align([" " + text])
        assert row == ((*counts[0], groups[0], sorted(links.tolist())) if good[0] else (0, 0, 0, "", []))


def test_texts_that_a_tokenizer_changes_have_no_tokens(aligner, monkeypatch):
    broken = [t if t != b"q" else b"k" for t in aligner.b_bytes]
    monkeypatch.setattr(aligner, "b_bytes", broken)
    aligner.forget()
    try:
        assert [r[:4] for r in aligner.rows(["fine text", "qqqq zqzqz"])][1] == (0, 0, 0, "")
        assert next(iter(aligner.rows(["fine text"])))[0] > 0
    finally:
        aligner.forget()


def test_memory_starts_anew(aligner, monkeypatch):
    monkeypatch.setattr(crosstoken, "REMEMBERED", 3)
    monkeypatch.setattr(crosstoken, "_TEXTS_AT_ONCE", 1)
    texts = ["one two three four", "five six one", "one two three four"]
    rows = [(r[0], r[3], r[4].tolist()) for r in aligner.rows(texts)]
    assert rows[0] == rows[2] and len(aligner.number) < 12
    aligner.forget()


def test_pairs_are_bounded_by_the_vocabularies(corpus, aligner):
    a, b = aligner.a_bytes, aligner.b_bytes
    pairs = [r.pair for r in crosstoken.pair_counts(crosstoken.linked(corpus, A, B)).collect()]
    assert all(a[p >> 32].endswith(b[p & (1 << 32) - 1]) or b[p & (1 << 32) - 1].endswith(a[p >> 32]) for p in pairs)
    assert len(pairs) <= crosstoken.most_pairs(a, b) < 1_000_000
    small = crosstoken.most_pairs([b"abc", b"c"], [b"c", b"bc", b"zabc", b"c"])
    assert small == sum(x.endswith(y) or y.endswith(x) for x in (b"abc", b"c") for y in (b"c", b"bc", b"zabc", b"c"))


def test_salted_counts_and_ties(spark):
    rows = spark.createDataFrame([([(1 << 32) | 9, (2 << 32) | 9], [2, 1]), ([(2 << 32) | 9, (3 << 32) | 8], [1, 5]), ([], [])], "pairs array<long>, times array<int>").repartition(3)
    got = {(r.pair >> 32, r.pair & (1 << 32) - 1): (r["count"], r.best) for r in crosstoken.pair_counts(rows).collect()}
    assert got == {(1, 9): (2, True), (2, 9): (2, True), (3, 8): (5, True)}


def test_links_are_laid_out_by_repetition(aligner, monkeypatch):
    """Tokens without bytes end where the token before them ends, and are linked there as well."""
    monkeypatch.setattr(aligner, "a", Fake([[5, 6, 7]]))
    monkeypatch.setattr(aligner, "b", Fake([[1, 2, 3]]))
    for side, lengths in (("a", {5: b" x", 6: b"", 7: b"yz"}), ("b", {1: b" x", 2: b"y", 3: b"z"})):
        monkeypatch.setattr(aligner, f"{side}_bytes", lengths)
        monkeypatch.setattr(aligner, f"{side}_length", np.array([len(lengths.get(i, b"")) for i in range(8)]))
    good, counts, groups, _, links = aligner.align([" xyz"])
    assert good.all() and counts.tolist() == [[3, 3, 2]] and groups == ["5,6|1;7|2,3"]
    assert [(p >> 32, p & (1 << 32) - 1) for p in links.tolist()] == [(5, 1), (6, 1), (7, 3)]


class Fake:
    def __init__(self, ids):
        self.ids = ids

    def encode_batch(self, texts, add_special_tokens):
        return [type("E", (), {"ids": i}) for i in self.ids]

    def encode(self, texts, num_threads):
        return self.ids


def test_special_strings_are_plain_text(aligner):
    special = {t["id"] for t in json.loads(open(A).read())["added_tokens"]}
    assert not special & set(aligner.a.encode(" <|endoftext|>", add_special_tokens=False).ids)
