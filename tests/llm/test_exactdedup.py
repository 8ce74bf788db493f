"""Exact duplicates against a plain version, with clashing digests, ties and hot groups."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assetloom.llm import exactdedup, registry


def plain(rows):
    """rows: (doc_id, text). What mark() gives, digest in hex."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for content, members in groups.items():
        best = sorted(members)
        digest = hashlib.sha256(content.encode()).hexdigest()
        out += [(m[3], best[0][3], len(members), i == 0, digest) for i, m in enumerate(best)]
    return out


def marks(docs, **how):
    return [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in exactdedup.mark(docs, **how).collect()]


@pytest.mark.parametrize("name", ["corpus", "tricky", "no_rows"])
def test_marks(request, name):
    docs = request.getfixturevalue(name)
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(repr, marks(docs))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["corpus", "tricky"])
def test_contents_under_one_digest_stay_apart(request, name):
    docs = request.getfixturevalue(name)
    weak = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2))
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = [m[:4] for m in marks(docs, digest=weak)]
    assert sorted(map(repr, got)) == sorted(repr(w[:4]) for w in want)
    assert sorted(r.text or "" for r in exactdedup.keep_one(docs, digest=weak).collect()) == sorted(r.text or "" for r in exactdedup.keep_one(docs).collect())


def test_keep_one_returns_whole_rows(tricky, no_rows):
    kept = exactdedup.keep_one(tricky)
    assert kept.columns == tricky.columns and not Counter(map(tuple, kept.collect())) - Counter(map(tuple, tricky.collect()))
    want = [w[1] for w in plain([(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]) if w[3]]
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, want))
    assert exactdedup.keep_one(no_rows).count() == 0


def test_extreme_ids_and_lengths(spark):
    rows = [(2**63 - 1, "a a"), (-(2**63), "aa "), (None, "a a"), (0, "aa"), (5, "b"), (-5, "b")]
    assert sorted(map(repr, marks(spark.createDataFrame(rows, "doc_id long, text string")))) == sorted(map(repr, plain(rows)))


def test_many_equal_rows_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "AT_ONCE", 7)
    docs = spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    got = exactdedup.mark(docs).collect()
    assert len(got) == 50 and sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {50}


def test_a_hot_text_reaches_a_task_once_from_each_task(spark):
    """What leaves the first stage: one row for each task, salt and content."""
    docs = spark.range(10_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("hot copy").alias("text"))
    best = exactdedup.winners(exactdedup._keyed(docs, exactdedup.sha256))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") == 2 and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert [tuple(r)[2:] for r in best.select("digest", "content", exactdedup.id_of(F.col("best")), "n").collect()] == [(0, 10_000)]


def test_no_python_in_the_plan(corpus):
    plan = exactdedup.mark(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query(spark, small, corpus):
    got = registry.QUERIES["op12_exact_dedup"](spark, small)
    assert got.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(plain([(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]))
