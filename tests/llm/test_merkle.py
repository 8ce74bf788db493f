"""The Merkle manifest against a plain recursive version."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assetloom.llm import merkle, registry


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root, and each leaf's steps [(sibling or None, whether it is on the left)]."""
    paths, at, nodes = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            paths[i].append((nodes[other] if other < len(nodes) else None, other < place))
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [place // 2 for place in at]
    return nodes[0], paths


def plain(rows):
    """rows: dicts with FIELDS. What audit() gives."""
    groups = defaultdict(list)
    for r in rows:
        own = leaf([r[c] for c in merkle.FIELDS])
        bad = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        found = leaf([r[c] + bad if c == "n_chars" and r[c] is not None else r[c] for c in merkle.FIELDS])
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, own, r["doc_id"], found))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda m: m[:3])
        trees.append(tree([m[2] for m in groups[g]]))
    if not trees:
        return []
    root, ups = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), up in zip(names, trees, ups):
        for m, path in zip(groups[g], paths):
            node = m[4]
            for sibling, left in path + up:
                node = h(sibling or "", node) if left else h(node, sibling or "")
            out.append((m[3], m[2], subroot, root, h(*[s or "" for s, _ in path + up]), node, node == root))
    return out


def same(docs):
    want = plain([r.asDict() for r in docs.select(*merkle.FIELDS).collect()])
    assert sorted(map(repr, map(tuple, merkle.audit(docs).collect()))) == sorted(map(repr, want))
    return want


@pytest.mark.parametrize("name", ["corpus", "tricky", "no_rows"])
def test_audit(request, name):
    same(request.getfixturevalue(name))


@pytest.mark.parametrize("n", [1, 2, 3, 32, 33, 65, 130])
def test_groups_of_every_size(spark, monkeypatch, n):
    """With two levels a stride, so that proofs pass several strides."""
    monkeypatch.setattr(merkle, "STRIDE", 2)
    docs = spark.range(n + 1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") < n, "en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    assert all(row[-1] or zlib.crc32(str(row[0]).encode()) % 7 == 0 for row in same(docs))


def test_many_groups(spark):
    same(spark.range(90).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.concat(F.lit("g"), F.col("id") % 45).alias("lang"), F.col("id").alias("n_chars"), F.lit("t").alias("text")))


def test_a_row_that_fills_a_third_of_the_table(spark):
    hot = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(2**63 - 1).alias("n_chars"), F.lit("t").alias("text"))
    same(hot)


def test_any_change_is_found_and_names_no_other_row(corpus):
    rows = merkle.audit(corpus).collect()
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_places_split_a_hot_group(spark):
    rows = spark.range(4000, numPartitions=4).select(F.lit("=en").alias("group"), F.col("id").alias("doc_id"), F.lit("x").alias("leaf"))
    placed = merkle.places(rows, ["doc_id", "leaf"])
    assert [tuple(r) for r in placed.orderBy("place").select("place", "doc_id", "n").collect()] == [(i, i, 4000) for i in range(4000)]


def test_query(spark, small):
    kinds = dict(registry.QUERIES["op13_merkle"](spark, small).dtypes)
    assert kinds == {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
