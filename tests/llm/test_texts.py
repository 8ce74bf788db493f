"""Operators on texts against brute-force versions, with the awkward rows of every contract."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assetloom.llm import brown, decontaminate, mixing, nearcopies, pii, quality, registry, sharding, simhash, tokencount
from assetloom.operators.components import star_links

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, word string"
ODD = [None, "", " \n\t", "one", "two words", "A b\u00a0c", "x" * 5000, "é" * 300 + " " + "y z " * 2000, "7" * 4000, "+" * 3000, "same text here", "same text here"]


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null sources, odd texts, and columns named like the operators' own."""
    rows = [(i, t, None, "s" if i % 3 else None, 0, "a", "b", "c") for i, t in enumerate(ODD)]
    rows += [(None, "no id at all", None, None, None, None, None, None), (3, "one", None, "s", 1, "", "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- simhash

def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Least id by union-find over all pairs at two or fewer bits; prints: [(id, fingerprint)]."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, f, least.get(find(i))) for i, (k, f) in enumerate(prints)]


def simhash_rows(docs):
    return [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()]


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_simhash(request, name):
    docs = request.getfixturevalue(name)
    same(simhash_rows(docs), components([(k, fingerprint(t)) for k, t in rows_of(docs)]))


def test_simhash_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] == int.from_bytes(xxhash.xxh64_digest(b"a b c", seed=42), "big", signed=True)


@pytest.mark.parametrize("crowded", [0, 2, 64])
def test_near_links_keep_components_also_where_crowded(spark, monkeypatch, crowded):
    """Random, clustered and chained fingerprints; 0 and 2 send full grid points down the exact other way."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)}
    for centre in list(prints)[:6]:
        walk = centre
        for _ in range(20):
            walk ^= 1 << int(rng.integers(0, 62))
            prints |= {walk, centre ^ 1 << int(rng.integers(0, 62))}
    prints = sorted(prints)
    fps = spark.createDataFrame([(x,) for x in prints], "fp long")
    from assetloom.operators.components import connected_components

    root = {r.node: r.root for r in connected_components(simhash.near_links(fps)).collect()}
    want = components([(x, x & (1 << 64) - 1) for x in prints])
    assert {x: root.get(x, x) for x in prints} == {x: least for x, _, least in want}


def test_components_of_a_long_chain_and_a_star(spark):
    from assetloom.operators.components import connected_components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


@pytest.mark.parametrize("at_once", [1 << 17, 16])
def test_few_links_need_no_round_and_more_give_the_same(spark, monkeypatch, at_once):
    from assetloom.operators import components as module

    rounds, star = [], module._large_star
    monkeypatch.setattr(module, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(module, "_large_star", lambda edges: rounds.append(1) or star(edges))
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(100)]
    got = {r.node: r.root for r in module.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    want = dict(zip(*map(np.ndarray.tolist, module.star_links(*map(np.array, zip(*[e for e in edges if e[0] != e[1]], strict=True)))), strict=True))
    assert got == {x: want.get(x, x) for e in edges if e[0] != e[1] for x in e}
    assert bool(rounds) == (at_once == 16)


def test_places_ask_for_each_ending_once_and_give_the_units(monkeypatch):
    units, asked, ending = brown.Units([b"the", b"of"]), [], brown.ending
    words = b"the cat of the hat sat of a cat cat".split()
    want = [units[w] for w in words]
    monkeypatch.setattr(brown, "ending", lambda w: asked.append(w) or ending(w))
    places = brown.Places(units)
    numbers = places.numbers(words)
    assert places.unit(numbers).tolist() == want
    assert asked == [b"cat", b"hat", b"sat", b"a"] and places.others() == ["cat", "hat", "sat", "a"]
    assert numbers.tolist() == [1, 3, 2, 1, 4, 5, 2, 6, 3, 3]


@pytest.mark.parametrize("crowded", [64, 2])
def test_pipeline_stage_leaves_no_near_copies(spark, documents, odd, monkeypatch, crowded):
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "CROWDED", crowded)
    rng = np.random.default_rng(8)
    base = [[f"w{rng.integers(0, 5000)}" for _ in range(150)] for _ in range(5)]
    rows = [(None if k == 9 else k % 60, " ".join("new" if rng.random() < 0.001 * (k % 40) else w for w in base[k % 5])) for k in range(70)]
    edited = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (edited, odd) if crowded == 2 else (edited, odd, documents):
        kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
        assert kept.columns == docs.columns
        left, had = rows_of(kept), rows_of(docs)
        assert not Counter(left) - Counter(had)
        sets = [frozenset(nearcopies.shingles((t or "").encode()).tolist()) for _, t in left]
        alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
        assert not any(alike(a, b) for i, a in enumerate(sets) for b in sets[:i])
        # Each text that went is joined to one that stayed by a chain of pairs at 0.8.
        new, rest = set(sets), {frozenset(nearcopies.shingles((t or "").encode()).tolist()) for _, t in had} - set(sets)
        while new:
            new = {b for b in rest if any(alike(a, b) for a in new)}
            rest -= new
        assert not rest


def test_grid_of_the_pipeline_stage_meets_every_pair_within_its_radius():
    """Sets of 1 to 300 sequences and partners at 0.8 or just above it, whatever counts as common, also where segments or blocks are few."""
    rng, met = np.random.default_rng(4), 0
    for k in range(3000):
        n = int(rng.integers(1, 12 if k % 2 else 300))
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        if k % 5 == 0:  # all in one block
            a = np.unique(a << 20)
        gone = int(rng.integers(0, n // 5 + 1))
        new = int(rng.integers(0, max(int((n - gone) / 0.8 + 1e-6) - n, 0) + 1))
        added = rng.integers(-(2**63), 2**63 - 1, new)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], added << 20 if k % 5 == 0 else added]))
        if np.array_equal(a, b) or nearcopies.similarity(a, b) < 0.8 - 1e-12:
            continue
        rank = lambda x: np.where(x % 3 == 0, x % 1000, 0) if k % 4 else np.zeros(len(x), np.int64)  # noqa: B023, E731
        (pa_, _), (pb, _) = (nearcopies.grid_points(x, rank(nearcopies.segments(x))) for x in (a, b))
        assert np.intersect1d(pa_, pb).size, (a, b)
        assert max(len(pa_), len(pb)) <= 2 * (0.25 * max(len(a), len(b)) + 1)
        met += 1
    assert met > 1000
    unlike = [nearcopies.grid_points(np.unique(rng.integers(-(2**63), 2**63 - 1, 200)), np.zeros(200, np.int64))[0] for _ in range(50)]
    assert len(np.unique(np.concatenate(unlike))) == sum(map(len, unlike))


def test_differences_of_near_copies_share_as_many_sequences_as_said():
    """Pairs at 0.8, both not near a third set: the differences from it share at least ``shared_at_least`` of either."""
    rng, met = np.random.default_rng(11), 0
    for _ in range(4000):
        n = int(rng.integers(5, 120))
        led = np.unique(rng.integers(0, 400, n))
        a = np.unique(np.concatenate([rng.permutation(led)[int(rng.integers(0, n // 3 + 1)) :], rng.integers(400, 500, int(rng.integers(0, n // 3 + 1)))]))
        b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, n // 6 + 1)) :], rng.integers(400, 500, int(rng.integers(0, n // 6 + 1)))]))
        if nearcopies.similarity(a, b) < 0.8 - 1e-12 or max(nearcopies.similarity(a, led), nearcopies.similarity(b, led)) >= 0.8 - 1e-12:
            continue
        apart = [np.setxor1d(x, led) for x in (a, b)]
        assert len(np.intersect1d(*apart)) >= max(nearcopies.shared_at_least(len(d), len(x), len(led)) for d, x in zip(apart, (a, b), strict=True))
        met += 1
    assert met > 300


def test_crowded_near_copies_leave_one_and_texts_apart_stay(spark, monkeypatch):
    """A text, 200 edits of it that are near none, 50 near copies of it and 40 of one edit: all held together by common sequences."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    edited = lambda words, n: [f"e{rng.integers(0, 1 << 40)}" if i in gone else w for gone in [set(rng.permutation(len(words))[:n].tolist())] for i, w in enumerate(words)]
    base = [f"w{rng.integers(0, 1 << 40)}" for _ in range(800)]
    far = edited(base, 30)
    texts = [base, *(edited(base, 22) for _ in range(200)), *(edited(base, 3) for _ in range(50)), *(edited(far, 2) for _ in range(40))]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "CROWDED", 16)
    left = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect())
    assert len(left) == 202 and {*range(1, 201)} < {*left}
    assert sum(x in (0, *range(201, 251)) for x in left) == 1 and sum(x > 250 for x in left) == 1


def test_crowded_near_copies_leave_one_of_each_chain(spark, monkeypatch):
    """Texts that drift away from one another: whoever is near a leader may be the only way on to those that are not."""
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "CROWDED", 4)
    rng = np.random.default_rng(13)
    base = [f"w{rng.integers(0, 1 << 40)}" for _ in range(400)]
    texts = [base]
    for i in range(120):
        words = list(texts[-1] if i % 30 and i > 60 else texts[int(rng.integers(0, len(texts)))])
        for k in rng.permutation(300)[: int(rng.integers(2, 10))]:
            words[k] = f"e{rng.integers(0, 1 << 40)}"
        texts.append(words)
    texts = [" ".join(x) for x in texts]
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    edges = [(i, j) for j in range(len(sets)) for i in range(j) if nearcopies.similarity(sets[i], sets[j]) >= 0.8 - 1e-12]
    nodes, roots = (x.tolist() for x in star_links(*map(np.array, zip(*[(i, j) for i, j in edges], strict=True))))
    root = dict(zip(nodes, roots, strict=True))
    groups = {root.get(i, i) for i in range(len(texts))}
    assert 1 < len(groups) < 20 and len(edges) < len(texts) ** 2 / 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    assert sorted(root.get(i, i) for i in left) == sorted(groups)


def test_a_near_copy_of_a_leader_joins_texts_that_are_not(spark, monkeypatch):
    """60 texts near one text only, which is near the leaders of all points that it shares with them, and to which they are not."""
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "CROWDED", 16)
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    rng = np.random.default_rng(14)
    base = [f"w{rng.integers(0, 1 << 40)}" for _ in range(800)]
    edit = lambda places: {int(k): f"e{rng.integers(0, 1 << 40)}" for k in places}
    ours, theirs = edit((25, 35)), edit(range(42, 100, 6))
    edits = [{}, ours | theirs, ours | edit([8])]  # leaders, and the text that joins
    edits += [ours | edit(rng.permutation(70)[:16] * 8 + 120) for _ in range(60)] + [theirs | edit([710 + k]) for k in range(30)]
    texts = [" ".join(e.get(k, w) for k, w in enumerate(base)) for e in edits]
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    near = [[nearcopies.similarity(a, b) >= 0.8 for b in sets] for a in sets]
    assert all(near[0][k] and near[1][k] for k in (0, 1, 2, *range(63, 93)))
    assert all([j for j in range(93) if near[k][j]] == [2, k] for k in range(3, 63))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.keep_one_of_each(spark, docs, "").count() == 1


# --- personal data

def base_spans(text):
    text, out = text or "", []
    for place, (kind, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
                good = 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
            else:
                good = kind == "email" or 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), place, kind, m.end()))
    return sorted(out)


PII_TEXTS = [
    "a@b.c", "x@y.com@z.org", "x@y.com_a@z.org and -%@q-.r.s", "mail me at joe.doe+x@mail.example.com, or +1 (743) 555-3824!", "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8.9",
    "é😀 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4012888888881881", "+12 34 +1234567890 ++49 (30) 1234-5678 +1-----2", "joe [at] example [dot] com; call (555) 123-4567 now", "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    "9" * 3000 + " 8.8.8.8 " + "a." * 3000 + "@x.y", "4111111111111111 " * 400, "@" * 2000, "1 " * 4000,
]


def test_pii_base_spans(spark, documents, odd, empty):
    made = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    for docs in (made, documents, odd, empty):
        got, want = [], []
        for r in pii.find(docs).collect():
            got.append((r.doc_id, [(s.start, s.place, s.kind, s.end) for s in r.base]))
            assert {(s.start, s.end, s.kind) for s in r.base} <= {(s.start, s.end, s.kind) for s in r.spans}
            assert [(s.start, s.place) for s in r.spans] == sorted((s.start, s.place) for s in r.spans)
        for k, t in rows_of(docs):
            want.append((k, base_spans(t)))
        same(got, want)


def test_pii_query_digest(spark, small, documents):
    texts = dict(rows_of(documents))
    for r in registry.op2_pii(spark, small).collect():
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(joined.count(k) for k in ("email:", "ip:", "card:", "phone:"))


def test_pii_votes_reveal_reliable_labelers(spark):
    good = [(f"please call my phone +1 (555) 123-{i:04d} today",) for i in range(60)]
    bad = [(f"release version 7{i}.900.3.4 of build 99999.1.2.{i}",) for i in range(60)]
    loose = [(f"my phone is (212) 555-{i:04d} thanks",) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(good + bad + loose)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert all(not rows[i].spans for i in range(60, 120))
    assert sum(bool(rows[i].spans) for i in range(120, 140)) >= 15


def test_expectation_maximisation_finds_the_reliable_labelers():
    """Votes drawn from known reliabilities: real spans are told apart far better than by the votes' sum."""
    rng = np.random.default_rng(7)
    real = rng.random(4000) < 0.3
    right = [0.95, 0.9, 0.85, 0.5]
    votes = [tuple(int(1 if (rng.random() < p) == bool(z) else -1) for p in right) for z in real]
    counts = sorted(Counter(votes).items())
    q = dict(zip([v for v, _ in counts], pii.expectation_maximisation(counts), strict=True))
    found = np.array([q[v] > 0.5 for v in votes])
    by_sum = np.array([sum(v) > 0 for v in votes])
    assert (found == real).mean() > max(0.93, (by_sum == real).mean())


def test_pii_recall_of_loose_forms(spark, documents):
    """Spelled-out addresses, IPv6 and national numbers in whole texts, beside order numbers and parts of words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(5))
    hexa = lambda: f"{rng.randrange(1, 65536):x}"
    three, four = (lambda: str(rng.randrange(200, 999))), (lambda: f"{rng.randrange(10000):04}")
    forms = [
        ("email", lambda: f"{word()}.{word()} [at] {word()}.{rng.choice(['com', 'museum', 'co.uk', 'berlin'])}"), ("email", lambda: f"{word()}(at){word()} [dot] {rng.choice(['net', 'photography'])}"), ("email", lambda: f"{word()} at {word()} dot org"),
        ("ip", lambda: ":".join(hexa() for _ in range(8))), ("ip", lambda: f"2600:db8:{hexa()}::{hexa()}"), ("ip", lambda: f"fe80::{hexa()}:{hexa()}"),
        ("phone", lambda: f"({three()}) 555-{four()}"), ("phone", lambda: f"{three()}-555-{four()}"), ("phone", lambda: f"{three()}.555.{four()}"),
    ]
    not_any = [lambda: f"order {three()}-{three()}-{four()}", lambda: f"x{word()}{three()}-555-{four()}y", lambda: f"meet [at] {word()}", lambda: f"{word()} at {word()}", lambda: "10:20:30"]
    docs, planted = [], set()
    for i, r in enumerate(documents.where("text is not null").orderBy("doc_id").limit(150).collect()):
        kind, make = rng.choice(forms)
        value, lead = make(), rng.choice(["", "", {"email": "contact ", "ip": "host ", "phone": "call "}[kind]])
        text = f"{rng.choice(not_any)()}. {lead}"
        planted.add((i, len(text), len(text) + len(value), kind))
        docs.append((i, f"{text}{value}. {r.text}"))
    found = pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    extra = {(r.doc_id, s.start, s.end, s.kind) for r in found for s in r.spans if s not in r.base}
    assert len(extra & planted) >= 0.9 * len(planted) and len(extra - planted) <= 0.05 * len(planted)


def test_pii_runs_no_python(spark, documents):
    for df in (pii.candidates(documents), pii.placed(pii.candidates(documents))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_pii_of_texts_with_very_many_spans(spark):
    """Texts with 20,000 and 80,000 spans: every one is found, and four times as many take far less than sixteen times as long."""
    import time

    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"a{i}@b.org 10.0.0.{i % 256}" for i in range(n // 2))
        began = time.time()
        r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        took.append(time.time() - began)
        assert len(r.base) == n and [(s.start, s.end) for s in r.base] == [(m.start(), m.end()) for m in re.finditer(r"[^ ]+", text)]
    assert took[1] < 10 * took[0]


# --- language model

def test_brown_base_score_and_normalisation(documents, odd, empty):
    for docs in (documents, odd):
        texts = rows_of(docs)
        tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
        fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5
        c = Counter(w for k, t in texts if fold(k) != 1 for w in tokens(t))
        n, v = sum(c.values()), len(c)
        want = sorted((k is None, k or 0, fold(k) == 1, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for k, t in texts)
        got = brown.score(docs).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert brown.score(empty).count() == 0


def test_brown_beats_single_words_on_held_out_texts(spark, documents):
    rows = [r for r in brown.score(documents).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_brown_probabilities_sum_to_one(documents):
    from assetloom.llm.common import utf8

    model, others = brown.fit(documents.select(utf8(F.col("text")).alias("text")))
    rows = others.collect()
    n = np.concatenate([model.core_n[1:], [r.n for r in rows]])
    of = np.concatenate([model.of_unit[1 : len(model.core_n)], [r["class"] for r in rows]]).astype(int)
    assert (of != brown.END).all() and len({r.word for r in rows}) == len(rows) and len(rows) + model.units.core + 1 == model.types
    mass = np.bincount(of, weights=10 ** model.emission(n, of), minlength=brown.CLASSES) + 10 ** model.emission(np.zeros(brown.CLASSES), np.arange(brown.CLASSES))
    assert np.allclose(mass[1:], 1)
    assert np.allclose(np.exp(brown.smoothed(np.random.default_rng(0).integers(0, 99, (64, 64)))).sum(axis=1), 1)


def test_brown_blocks_are_bounded_by_tokens(spark, documents, monkeypatch):
    """One partition of few distinct words is several blocks, and scores stay as they are."""
    docs = documents.select("doc_id", "text").limit(60).coalesce(1)
    want = sorted((r.doc_id, round(r.score, 6), r.n_known) for r in brown.score(docs).collect())
    monkeypatch.setattr(brown, "BLOCK_TOKENS", 500)
    model, _ = brown.fit(docs.select(F.col("text").cast("binary").alias("text")))
    prepared = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(partial(brown._prepare_batches, sent=spark.sparkContext.broadcast(model), block_tokens=500), brown._PREPARED)
    tokens = [r.n for r in prepared.where("words is null").groupBy("block").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest")).collect()]
    assert len(tokens) > 5
    assert sorted((r.doc_id, round(r.score, 6), r.n_known) for r in brown.score(docs).collect()) == want


@pytest.mark.parametrize("core_share", [20, 0])
def test_brown_scores_are_the_formulas(spark, monkeypatch, core_share):
    """Every step by hand on a small corpus, from the classes that the model gives."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[int(x)] for x in np.minimum(rng.pareto(1.0, 30) * 3, 59))) for i in range(80)] + [(500, "never seen w1"), (501, None), (501, "")], "doc_id long, text string")
    monkeypatch.setattr(brown, "CORE_SHARE", core_share)
    got = {(r.doc_id, r.n_tokens): r for r in brown.score(docs).collect()}
    fold = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    rows = [(k, (t or "").split()) for k, t in rows_of(docs)]
    train = [t for k, t in rows if not fold(k)]
    model, others = brown.fit(spark.createDataFrame([(" ".join(t).encode(),) for t in train], "text binary"))
    # Without a share every training word is exchanged.
    assert 0 < model.units.core <= 20 if core_share else model.units.core == len({w for t in train for w in t}) and others.isEmpty()
    tail = {r.word: (r.n, r["class"]) for r in others.collect()}
    count = Counter(w for t in train for w in t)

    def of(w):
        u = model.units[w.encode()]
        return int(model.of_unit[u]) if u <= model.units.core or w not in tail else tail[w][1]

    assert all(count[w] == n for w, (n, _) in tail.items())
    pairs = np.zeros((brown.CLASSES, brown.CLASSES))
    for t in train:
        np.add.at(pairs, ([0, *map(of, t)], [*map(of, t), 0]), 1)
    step = brown.smoothed(pairs) / np.log(10)
    tokens, types = np.zeros(brown.CLASSES), np.zeros(brown.CLASSES)
    for w, n in count.items():
        tokens[of(w)] += n
        types[of(w)] += 1
    for k, t in rows:
        c = [0, *map(of, t), 0]
        want = sum(step[a, b] for a, b in zip(c, c[1:], strict=False)) + sum(np.log10((count[w] + 0.5) / (tokens[of(w)] + 0.5 * (types[of(w)] + 1))) for w in t)
        assert got[k, len(t) + 1].score == pytest.approx(want)


def test_brown_words_follow_their_neighbours():
    """A word that stands where one class stands goes there; one met once stays with its ending."""
    pairs = np.full((brown.CLASSES, brown.CLASSES), 10)
    pairs[1, 2] = pairs[2, 3] = 5000
    before, after = np.zeros((2, brown.CLASSES)), np.zeros((2, brown.CLASSES))
    before[:, 1], after[:, 3] = [50, 0], [50, 0]
    before[1, 5] = after[1, 6] = 1
    assert brown.best_classes(before, after, np.array([9, 9]), pairs).tolist() == [2, 9]


def test_brown_scores_don_t_depend_on_the_batches(spark, documents):
    want = {r.doc_id: r.score for r in brown.score(documents).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.doc_id: r.score for r in brown.score(documents.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_brown_profiles_are_handed_on_in_parts(monkeypatch):
    """Small parts, and words cut over batches, give the same classes."""
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)).encode() for _ in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7], pa.binary())], ["text"]) for i in range(0, 50, 7)]
    units = brown.Units([b"w1", b"w2", b"w3"])
    of_unit = rng.integers(1, brown.CLASSES, brown.n_units(3))
    state, pairs = SimpleNamespace(value=(units, of_unit)), rng.integers(0, 100, (brown.CLASSES, brown.CLASSES))

    def classes(size):
        parts = [pa.Table.from_batches([b]) for b in brown._profile_batches(iter(batches), state)]
        rows = pa.concat_tables(parts).sort_by("word").combine_chunks().to_batches(max_chunksize=size)
        return parts, [r for b in brown._class_batches(rows, pairs, of_unit[-brown.ENDINGS :]) for r in b.to_pylist()]

    parts, want = classes(1000)
    assert len(parts) == 1 and sum(r["n"] for r in want) == sum(w not in units.keys() or units[w] > 3 for t in texts for w in t.split())
    monkeypatch.setattr(brown, "_PENDING", 9)
    for size in (1, 3):
        parts, got = classes(size)
        assert len(parts) > 5 and got == want


def test_exchange_gain_is_the_likelihood_change():
    rng = np.random.default_rng(5)
    units, classes = 12, 4
    big = rng.integers(0, 9, (units, units))
    of = np.array([0] + [1 + i % 3 for i in range(units - 1)])

    def table(assigned):
        out = np.zeros((classes, classes), dtype=int)
        np.add.at(out, (assigned[:, None].repeat(units, 1), assigned[None, :].repeat(units, 0)), big)
        return out

    plogp = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    value = lambda p: plogp(p) - plogp(p.sum(axis=1)) - plogp(p.sum(axis=0))
    pairs = table(of)
    for u in range(1, units):
        right = np.bincount(of, weights=big[u], minlength=classes)
        left = np.bincount(of, weights=big[:, u], minlength=classes)
        got = brown.exchange(right, left, int(of[u]), int(big[u, u]), pairs, pairs.sum(axis=1), pairs.sum(axis=0))
        tried = [value(table(np.where(np.arange(units) == u, c, of))) for c in range(classes)]
        assert tried[got] == pytest.approx(max(tried))


# --- mixing

def test_mixing_meets_its_targets(documents, odd, empty):
    for docs in (documents, odd, empty):
        plan = mixing.mix_plan(docs).collect()
        again = mixing.mix_plan(docs.repartition(3)).collect()
        same(plan, again)
        size = lambda t: len((t or "").encode().split())
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        same([(r.doc_id, r.size) for r in plan], [(k, size(t)) for k, t, _ in rows])
        of = defaultdict(int)
        for _, t, s in rows:
            of[s] += size(t)
        order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: 1 + i % 3 for i, s in enumerate(order)}
        target = {s: 0.0 for s in order}
        rest, free = float(sum(of.values())), set(order)
        while free and rest > 1e-9:
            share = rest / sum(weight[s] for s in free)
            above = {s for s in free if weight[s] * share > 3 * of[s] + 1e-9}
            if not above:
                target |= {s: weight[s] * share for s in free}
                break
            target |= {s: 3.0 * of[s] for s in above}
            rest -= sum(3.0 * of[s] for s in above)
            free -= above
        for s in order:
            own = [r for r in plan if r.source == s]
            assert {(r.source_size, round(r.target, 6)) for r in own} == {(of[s], round(target[s], 6))}
            assert abs(sum(len(r.copies) * r.size for r in own) - target[s]) <= max(r.size for r in own) / 2 + 1e-6
        assert all(len(r.copies) <= 3 and all(0 <= k < mixing.SHARDS for k in r.copies) for r in plan)


def test_the_tree_decides_what_is_read(documents):
    """Every source's blocks are dealt out completely, and the words of each shard near its blocks' words."""
    plan = mixing.mix_plan(documents).collect()
    words, target = Counter(), sum({r.source: r.target for r in plan}.values())
    for r in plan:
        for k in r.copies:
            words[k] += r.size
    assert max(abs(words[k] - target / 16) for k in range(16)) <= 3 * mixing.BLOCK_WORDS + 2 * max(r.size for r in plan)


def test_mixing_of_many_sources_and_of_more_blocks_than_one_draw_allows(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), (F.col("id") % 700).cast("string").alias("source"))
    want = mixing.mix_plan(docs).drop("copies").collect()
    monkeypatch.setattr(mixing, "SENT_SOURCES", 10)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 8)
    monkeypatch.setattr(mixing, "_LEAST_RANGES", 2)
    monkeypatch.setattr(mixing, "RANGE_WORDS", 64)
    got = mixing.mix_plan(docs).collect()
    same([tuple(r)[:-1] for r in got], [tuple(r) for r in want])
    taken = Counter()
    for r in got:
        taken[r.source] += len(r.copies) * r.size
    assert all(abs(taken[r.source] - r.target) <= 4 + 1e-6 for r in got)


def test_mix_of_odd_rows(odd, empty):
    """Null and equal ids, null sources, a source without words, columns with the operator's own names."""
    named = odd.withColumns({"mix_epoch": F.lit(1), "copies": F.lit("c"), "place": F.lit("p"), "target": F.lit("t"), "plan_key": F.lit("k")})
    for docs in (odd, named, empty):
        out = mixing.mix(docs)
        assert out.columns == [*docs.columns, "mix_shard", "mix_order"]
        had = Counter(map(repr, docs.collect()))
        assert all(n <= 3 * had[k] for k, n in Counter(map(repr, out.select(docs.columns).collect())).items())


def test_splitting_tree_keeps_quotas():
    quotas = np.array([100, 7, 0, 33])
    split = mixing.split_quotas(quotas, 5, np.random.default_rng(1))
    assert split.shape == (5, 4) and (split.sum(axis=0) == quotas).all() and split.min() >= 0
    assert np.ptp(split.sum(axis=1)) <= 2


def test_mix_repeats_rows(documents):
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(documents).collect()}
    out = mixing.mix(documents)
    assert out.columns == [*documents.columns, "mix_shard", "mix_order"]
    same([(r.doc_id, r.mix_shard) for r in out.collect()], [(k, s) for k, c in plan.items() for s in c])


def test_mixture_is_laid_out_by_shard_and_shuffle(spark, documents, empty, tmp_path):
    mixing.laid_out(mixing.mix(documents)).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    rows = [(r.mix_shard, r.mix_order) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert rows == sorted(rows) and len({s for s, _ in rows}) == mixing.SHARDS
    assert mixing.laid_out(mixing.mix(empty)).count() == 0


# --- quality

def test_quality_on_held_out_rows(spark):
    from conftest import DATA

    base = f"{DATA}/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    rows = [r for r in registry.op8_quality(spark, base).collect()]
    assert len(rows) == spark.read.parquet(f"{base}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert {r.held_out for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([b for a, b in held if a == 1]) > 0.98


def test_quality_without_usable_labels(spark, odd, empty):
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, none)
    assert {round(r.score, 6) for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0 and quality.keep_good(odd, model).count() == odd.count()


def test_quality_tells_texts_apart_by_their_words_alone(spark):
    """Good and bad texts of one shape: the same lengths, case and marks, other words."""
    rng = np.random.default_rng(12)
    words = [["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(300)] for _ in range(2)]
    text = lambda k: " ".join(words[k][rng.integers(0, 300)] if rng.random() < 0.3 else words[rng.integers(0, 2)][rng.integers(0, 300)] for _ in range(40)) + "."
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    held = [r for r in quality.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in held]) > 0.85


def test_quality_scores_odd_rows_and_is_the_same_again(spark, documents, odd, empty):
    from conftest import DATA

    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    model = quality.fit(documents, labels)
    again = quality.fit(documents.repartition(7).unionByName(documents), labels)
    assert (again.weight == model.weight).all() and (again.slope, again.shift) == (model.slope, model.shift)
    long = spark.createDataFrame([(1, "word " * 300_000), (None, None)], "doc_id long, text string")
    for docs in (odd, long, empty):
        got = quality.score(docs, model).collect()
        same([r.doc_id for r in got], [k for k, _ in rows_of(docs)])
        assert all(0 <= r.score <= 1 for r in got)
        kept = quality.keep_good(docs, model)
        assert kept.schema == docs.schema and kept.count() == sum(r.score >= quality.THRESHOLD for r in got)


def test_quality_features_against_plain_sets():
    """Two texts share a slot exactly where they share an n-gram, up to collisions of hashes, and the model is its formula."""
    flags = np.zeros(quality.SIZE, dtype=bool)
    grams = lambda t, n: {t.lower()[i : i + n] for i in range(len(t) - n + 1)}
    for t in ("Abc abc. Abc", "one two two\none two two", "é x", ""):
        raw = t.encode()
        parts = quality._parts(quality.features(raw, flags))
        words = raw.lower().split()
        assert len(parts[0]) == sum(len(grams(raw, n)) for n in range(1, 5))
        assert len(parts[1]) == len(set(words)) + len(set(zip(words, words[1:]))) + (t.count("two two") > 1)
        assert not flags.any()
    rows, y = [quality.features(t.encode(), flags) for t in ("good text", "bad text", "good word", "bad word")], [1, 0, 1, 0]
    model = quality.fit_model(rows, y)
    for x in rows:
        parts = [model.ratio[p] for p in quality._parts(x)]
        margin = model.bias + sum(model.weight[p] @ v / np.sqrt(v @ v + 1e-12) for p, v in zip(quality._parts(x), parts, strict=True))
        assert model.score(x) == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))))


def test_dual_coordinate_descent_separates():
    rows = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    w = quality._dual_coordinate_descent(rows, [np.ones(len(r)) for r in rows], np.array([1, -1, 1, -1]), 3, rounds=200)
    assert [np.sign(w[r].sum() + w[3]) for r in rows] == [1, -1, 1, -1]


def test_quality_training_rows_are_bounded_and_leave_the_fold_out(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 10)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.training_labels(labels).collect()
    assert len(got) == 10 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


# --- token counts

SPACED = ["", " ", "a", " a", "a ", "a  b", "a   b\n\n c \n", "x\n\ny", "\t\t z", "it's don't'S 'll ''s", "<|endoftext|> a <|endoftext|>", "a <|endoftext|>  b", "  <|endoftext|>\n", "é\u00a0 ü\u2003x  ", "1 23  456", "end \n", "\u3000 a", "a\u00a0 b", "a \u00a0b"]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(registry.TOKENIZER), Tokenizer.from_file(public_tokenizers.path(registry.TOKENIZER))


def test_token_counts_are_the_librarys(spark, documents, odd, empty, tmp_path):
    path, tok = library()
    spaced = spark.createDataFrame(list(enumerate(SPACED)), "doc_id long, text string")
    for i, docs in enumerate((spaced, documents, odd, empty)):
        want = [(k, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in rows_of(docs)]
        same([tuple(r) for r in tokencount.token_counts(docs, path, str(tmp_path / f"cache{i}")).collect()], want)


def test_token_units_by_property():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    path, tok = library()
    counter = tokencount.Counter(path)
    assert counter.by_word

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from(" \n\t\u00a0\u3000aZé1.'s!<|endoftext|>"), max_size=40))
    def check(text):
        assert "".join(tokencount.units_of(text)) == text
        assert counter.count([text]) == [len(tok.encode(text, add_special_tokens=False).ids)]

    check()


def test_token_cache_encodes_only_misses(spark, documents, tmp_path):
    path, _ = library()
    cache = str(tmp_path / "cache")
    first = documents.limit(50).cache()
    tokencount.fill_cache(first, path, cache)
    stored = spark.read.parquet(cache)
    n = first.select("text").distinct().count()
    assert stored.count() == n
    tokencount.fill_cache(documents, path, cache)
    assert spark.read.parquet(cache).count() == documents.select("text").distinct().count()
    tokencount.fill_cache(documents, path, cache)
    assert spark.read.parquet(cache).count() == documents.select("text").distinct().count()


def test_warm_cache_shuffles_no_text(spark, documents, tmp_path):
    path, _ = library()
    cache = str(tmp_path / "cache")
    tokencount.fill_cache(documents, path, cache)
    known = tokencount.read_cache(documents, cache, tokencount.tokenizer_version(path))
    assert tokencount._texts_of_misses(documents, known).count() == 0
    more = documents.unionByName(documents.limit(2).withColumn("text", F.concat("text", F.lit(" more"))))
    assert tokencount._texts_of_misses(more, known).count() == 2
    plan = tokencount._texts_of_misses(more, known)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# --- decontamination

def smith_waterman(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), dtype=int), 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


def test_alignment_is_smith_watermans():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 30))
        assert decontaminate.alignment(a, b)[0] == smith_waterman(a, b)


def test_contamination_against_alignment_of_everything(spark, small, documents):
    """Whole texts against all items that share enough words to reach the threshold: recall and precision 1."""
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r.item_id: decontaminate.words_of(r.text.encode()) for r in bench.collect()}
    number = defaultdict(lambda: len(number))
    ids = lambda words: np.array([number[w] for w in words], dtype=np.int64)
    want = {}
    for k, t in rows_of(documents):
        words = decontaminate.words_of((t or "").encode())
        for i, item in items.items():
            if len(item) >= decontaminate.LEAST_WORDS and sum((Counter(item) & Counter(words)).values()) >= decontaminate.THRESHOLD * len(item):
                best = decontaminate.alignment(ids(item), ids(words))[0] / (2 * len(item))
                if best >= decontaminate.THRESHOLD:
                    want[k, i] = round(best, 9)
    assert want and {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.contaminated(documents, bench).collect()} == want


def test_edited_copies_are_caught_and_clean_texts_left(spark, documents):
    rng = np.random.default_rng(4)
    item = [f"w{i}" for i in range(40)]
    filler = lambda n: [f"f{rng.integers(0, 999)}" for _ in range(n)]
    edited = item.copy()
    for i in (3, 11, 19, 27, 35):
        edited[i] = f"new{i}"
    del edited[22:24]
    texts = [filler(80) + item + filler(50), filler(500) + edited + filler(9), [w.upper() + "," for w in item], filler(300), item[:8] + filler(80), [], filler(3)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, None), (7, " ".join(item))] * 2, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (None, "a b c d", 0), (3, "two words", 0)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (7, 1), (7, 1)]
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 4, 5, 6]
    long = spark.createDataFrame([(1, "filler " * 400_000 + " ".join(edited))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(long, bench).collect()] == [(1, 1)]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_lone_edited_copies_against_full_alignment(spark):
    rng = np.random.default_rng(11)
    items = {i: [f"w{rng.integers(0, 400)}" for _ in range(n)] for i, n in enumerate([3, 4, 12, 25, 40, 41])}
    filler = lambda n: [f"f{rng.integers(0, 999)}" for _ in range(n)]
    texts = []
    for item in items.values():
        for step in (3, 4, 5, 6):
            texts.append([f"x{i}" if i % step == step - 1 else w for i, w in enumerate(item)])
            texts.append([w for i, w in enumerate(item) if i % step])
            texts.append([x for i, w in enumerate(item) for x in ([w, f"x{i}"] if i % step == 0 else [w])])
        texts.append([x for w in item for x in (w, "between")])
        texts.append(item[: len(item) // 2 + 1])
        for share in (0.2, 0.3, 0.4):
            texts.append([x for w in item for x in ([w], [w], ["new"], [], [w, "more"])[rng.integers(0, 5) if rng.random() < 2 * share else 0]])
    texts = [filler(rng.integers(0, 60)) + t + filler(rng.integers(0, 60)) for t in texts]
    # Exact copies elsewhere make an item's pairs commoner; a variant that repeats makes its own so.
    texts += [filler(9) + w + filler(9) for w in items.values() for _ in range(3)] + [texts[45]] * 20
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    score = {(k, i): smith_waterman(w, t) / (2 * len(w)) for k, t in enumerate(texts) for i, w in items.items() if set(w) & set(t)}
    for threshold in (decontaminate.THRESHOLD, 0.4, 0.8, 1.0):
        want = sorted((k, i, round(s, 9)) for (k, i), s in score.items() if s >= threshold)
        assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(docs, bench, threshold).collect()) == want
        kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench, threshold).collect()}
        assert kept == set(range(len(texts))) - {k for k, _, _ in want}


def test_benchmark_in_several_passes(spark, small, documents, monkeypatch):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    one = decontaminate.contaminated(documents, bench).collect()
    monkeypatch.setattr(decontaminate, "WORDS_PER_PASS", 300)
    same([(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(documents, bench).collect()], [(r.doc_id, r.item_id, r.score) for r in one])


# --- sharding

@pytest.fixture(scope="session")
def maps(spark):
    path = sharding.new_map(spark, 16)
    assert sharding.grow(spark, path, 1, 17) == 2
    return {"shard": sharding.read_map(spark, path, 1), "grown_shard": sharding.read_map(spark, path, 2)}


def test_slots_and_shards(spark, small, documents, odd, empty, maps):
    old = sharding.slot_map(16)
    new = sharding.grown(old, 17)
    assert np.ptp(np.bincount(old, minlength=16)) <= 1 and all(a == b or b == 16 for a, b in zip(old, new, strict=True))
    for docs in (documents, odd, empty):
        rows = sharding.assign(docs, maps).collect()
        data = lambda t: (t or "").encode()
        same([(r.doc_id, r.size, r.text_crc32) for r in rows], [(k, len(data(t)) + 1, zlib.crc32(data(t))) for k, t in rows_of(docs)])
        assert all(r.shard == old[r.virtual_slot] and r.grown_shard == new[r.virtual_slot] for r in rows)
        places = defaultdict(list)
        for r in rows:
            places[r.shard].append(r.slot)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        size = Counter()
        for r in rows:
            size[r.virtual_slot] += r.size
        assert all(r.slot_bytes == size[r.virtual_slot] for r in rows)
    whole = {r.doc_id: r.shard for r in sharding.assign(documents, maps).collect()}
    part = {r.doc_id: r.shard for r in sharding.assign(documents.where("doc_id % 3 = 0"), maps).collect()}
    assert part.items() <= whole.items()
    assert {r.law for r in registry.op4_virtual_slots(spark, small).collect()} == {"key"}


def test_sharding_keeps_the_documents_columns(documents, odd, empty, maps):
    """odd has a column named size, which gives way to the result's."""
    for docs in (documents, odd, empty):
        out = sharding.assign(docs, maps, keep=True)
        kept = [c for c in docs.columns if c != "size"]
        assert out.columns == [*kept, "size", "text_crc32", "virtual_slot", "slot_bytes", "shard", "grown_shard", "slot"]
        same([tuple(r) for r in out.select(kept).collect()], [tuple(r) for r in docs.select(kept).collect()])


def test_many_rows_without_an_id_are_numbered_in_pieces(spark, maps):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sharding.assign(docs, maps).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000))


def test_stored_maps_are_rebalanced_by_bytes(spark, documents):
    path = sharding.new_map(spark, 16)
    version = sharding.rebalance(documents, path, 1)
    one, two = ([r.shard for r in sharding.read_map(spark, path, v).orderBy("virtual_slot").collect()] for v in (1, version))
    assert version == 2 and one == sharding.slot_map(16) and one != two
    load = lambda m: Counter({r.shard: r.n for r in sharding.assign(documents, {"shard": sharding.read_map(spark, path, m)}).groupBy("shard").agg(F.sum("size").alias("n")).collect()})
    before, after = load(1), load(2)
    assert sum(before.values()) == sum(after.values()) and max(after.values()) - min(after.values()) < 0.5 * (max(before.values()) - min(before.values()))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sharding.write_map(spark, path, 2, one)


def test_rebalancing_moves_little_and_evens_out():
    rng = np.random.default_rng(6)
    sizes = [int(x) for x in rng.pareto(1.5, 4096) * 1000 + 1]
    before = sharding.slot_map(16)
    after = sharding.rebalanced(before, sizes, 16)
    load = np.bincount(after, weights=sizes, minlength=16)
    start = np.bincount(before, weights=sizes, minlength=16)
    assert np.ptp(load) < 0.5 * np.ptp(start) and sum(a != b for a, b in zip(before, after, strict=True)) < 1000
    assert sharding.rebalanced(before, [1] * 4096, 16) == before


def test_sharding_runs_no_python(documents, maps):
    plan = sharding.assign(documents, maps)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
