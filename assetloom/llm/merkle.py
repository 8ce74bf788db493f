"""A Merkle manifest of a dataset: a digest a row, a tree a group, and a tree over the groups' roots.

Nodes are rows (group, place, node). A level is a window over the nodes with one parent: the list of
its whole frame, in order, is the parent's preimage, and holds the sibling that a proof needs. Parents
are deduplicated before the next level: in a list one row speaks for each node, and after every
``STRIDE`` levels a block of leaves goes on as one row.

The rows of a block of 2^STRIDE places share a task, so one exchange serves STRIDE levels, and the
proofs' upper parts come down by a join on the same blocks, without another exchange of the leaves. No task sees more
of a group than some blocks; places come from ranged, counted keys, so a group, an id or a row that repeats may
hold any share of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import crc_of_id, repeated, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STRIDE = 5
TAMPERED_EVERY = 7
#: A step of a proof is a letter and the sibling's digest; with no sibling the node alone was hashed.
LEFT, RIGHT, ALONE = "L", "R", "="


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def preimage(values: list[Column]) -> Column:
    """Each value as its number of UTF-8 bytes, a colon and itself; a null as a hyphen."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def group_key(group: Column) -> Column:
    """A text that is never null and sorts like the group: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def places(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds place (from 0) and n, in ``group`` by the columns ``by``, to a row for each copy of ``rows``.

    Rows that agree in all columns are counted first. The kinds are ranged by group and ``by`` and summed up inside
    their range; the ranges' totals, one row for each range and group in it, move them on.
    """
    keys = ["group", *by]
    kinds = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    ranged = stored(kinds.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "merkle-places")
    totals = ranged.groupBy("part", "group").agg(F.sum("copies").alias("total"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.withColumns({"earlier": F.coalesce(F.sum("total").over(before), F.lit(0)), "n": F.sum("total").over(Window.partitionBy("group"))}).drop("total")
    inside = F.sum("copies").over(Window.partitionBy("part", "group").orderBy(*by, *[c for c in rows.columns if c not in keys]).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("through", inside).join(moved, ["part", "group"])
    each = repeated(placed, "copies", "copy")
    return each.select(*rows.columns, (F.col("earlier") + F.col("through") - F.col("copies") + F.col("copy")).alias("place"), "n")


def _stride(nodes: DataFrame) -> DataFrame:
    """Climbs STRIDE levels: node becomes the ancestor, path the steps to it; adds block.

    A group whose nodes have become one stays as it is.
    """
    rows = nodes.withColumns({"block": F.shiftright("place", STRIDE), "path": F.array().cast("array<string>")}).repartition("group", "block")
    for level in range(STRIDE):
        speaks = F.col("place") % (1 << level) == 0
        rows = rows.withColumn("parent", F.shiftright("place", level + 1))
        frame = Window.partitionBy("group", "block", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("run", F.collect_list(F.when(speaks, F.col("node"))).over(frame))
        second = F.shiftright("place", level) % 2 == 1
        step = F.when(F.size("run") < 2, F.lit(ALONE)).when(second, F.concat(F.lit(LEFT), F.element_at("run", 1))).otherwise(F.concat(F.lit(RIGHT), F.element_at("run", -1)))
        several = F.col("n") > (1 << level)
        rows = rows.withColumns({"path": F.when(several, F.array_append("path", step)).otherwise(F.col("path")), "node": F.when(several, digest(F.array_join("run", ""))).otherwise(F.col("node"))})
    return rows.drop("parent", "run")


def climb(nodes: DataFrame, most: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (group, place, n, node and others) with path, the steps to the root, and what ``above`` says.

    ``most`` is the largest n. ``above`` gets (group, node), a row for each group's root, and returns
    group, up (the further steps) and other columns.
    """
    rows = _stride(nodes)
    if most <= 1 << STRIDE:
        met = rows.join(above(rows.where("place = 0").select("group", "node")), "group")
    else:
        tops = rows.where(F.col("place") % (1 << STRIDE) == 0).select("group", F.col("block").alias("place"), F.shiftright(F.col("n") + ((1 << STRIDE) - 1), STRIDE).alias("n"), "node")
        higher = climb(stored(tops, "merkle-level"), -(-most >> STRIDE), above)
        met = rows.join(higher.drop("node", "n").withColumnsRenamed({"place": "block", "path": "up"}), ["group", "block"])
    return met.withColumn("path", F.concat("path", "up")).drop("block", "up")


def largest(placed: DataFrame) -> int:
    return placed.agg(F.max("n")).first()[0] or 0


def _over_groups(roots: DataFrame) -> DataFrame:
    """(group, subroot, up, root): the tree over the groups' roots, in the order of the groups."""
    rows = stored(roots, "merkle-groups")
    placed = stored(places(rows.select(F.lit("").alias("group"), F.col("group").alias("name"), "node"), ["name"]).withColumn("subroot", F.col("node")), "merkle-groups")
    done = climb(placed, largest(placed), lambda top: top.select("group", F.col("node").alias("root"), F.array().cast("array<string>").alias("up")))
    return done.select(F.col("name").alias("group"), "subroot", F.col("path").alias("up"), "root")


def manifest(leaves: DataFrame) -> DataFrame:
    """(group, doc_id, leaf, other columns; path, subroot, root) for rows with group, doc_id and leaf.

    Leaves of a group stand by id, null first; rows with equal ids by their digests. Rows that repeat
    are leaves of their own. No rows give no roots.
    """
    placed = stored(places(leaves, ["doc_id", "leaf"]).withColumn("node", F.col("leaf")), "merkle-leaves")
    return climb(placed, largest(placed), _over_groups).drop("node", "place", "n")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the steps of its proof."""

    def step(node, taken):
        side, sibling = F.substring(taken, 1, 1), F.substring(taken, 2, 64)
        return digest(F.when(side == LEFT, F.concat(sibling, node)).otherwise(F.concat(node, sibling)))

    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """The siblings' digests, one after the other."""
    return F.array_join(F.transform(path, lambda taken: F.substring(taken, 2, 64)), "")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(group, doc_id, leaf, found) of documents; found is the digest after tampering, where that changed it.

    Tampering adds 1 to n_chars where TAMPERED_EVERY divides the crc32 of the id; rows without an id or
    without n_chars stay. Nulls in any field have a code of their own, other columns are ignored.
    """
    own, changed = F.col("n_chars").cast("decimal(20,0)"), F.col("n_chars").cast("decimal(20,0)") + 1
    leaf = lambda n: digest(preimage([n if c == "n_chars" else F.col(c) for c in FIELDS]))
    tampered = F.col("doc_id").isNotNull() & F.col("n_chars").isNotNull() & (crc_of_id(F.col("doc_id")) % TAMPERED_EVERY == 0)
    return docs.select(group_key(F.col("lang")).alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("leaf"), F.when(tampered, leaf(changed)).alias("found"))


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of ``docs``.

    The manifest is that of the rows as given; each row is then checked, as tampered with, against the
    root. Null ids come first in their group, null languages are a group, the first; repeated rows
    have proofs of their own; an empty table gives no rows. Columns other than FIELDS are ignored.
    """
    rows = manifest(stored(document_leaves(docs), "merkle-rows"))
    found = rows.withColumns({"proof_sha256": digest(siblings(F.col("path"))), "folded_root": folded(F.coalesce("found", "leaf"), F.col("path"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql() -> str:
    """The same rows in DuckDB, level by level."""
    texts = {c: f"cast({c} as varchar)" for c in FIELDS}
    coded = lambda t: f"coalesce(cast(strlen({t}) as varchar) || ':' || {t}, '-')"
    leaf = lambda n: "sha256(" + " || ".join(coded(n if c == "n_chars" else texts[c]) for c in FIELDS) + ")"
    bit = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({texts['doc_id']}, ''), lambda s: cast(ascii(s) as bigint))), lambda a, b: {bit.replace('[c', '[xor(a, b)')}), 4294967295)"
    node = "sha256(case when s.h is null then w.f when w.p % 2 = 0 then w.f || s.h else s.h || w.f end)"
    return f"""
with recursive l as (select doc_id, lang, {leaf(texts["n_chars"])} as leaf,
    case when {crc} % {TAMPERED_EVERY} = 0 and n_chars is not null then {leaf("cast(cast(n_chars as hugeint) + 1 as varchar)")} end as found from documents),
leaves as (select *, row_number() over () as r, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by lang) as n from l),
up as (select 0 as l, lang, p, n, leaf as h from leaves
  union all select l + 1, lang, p // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by p)) from up where n > 1 group by l, lang, p // 2),
sub as (select lang, h, row_number() over (order by lang nulls first) - 1 as p, count(*) over () as n from up where n = 1),
top as (select 0 as l, p, n, h from sub union all select l + 1, p // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by p)) from top where n > 1 group by l, p // 2),
w as (select r, 0 as l, lang, p, n, coalesce(found, leaf) as f, '' as proof from leaves
  union all select w.r, w.l + 1, w.lang, w.p // 2, (w.n + 1) // 2, {node}, w.proof || coalesce(s.h, '')
  from w left join up s on s.l = w.l and s.lang is not distinct from w.lang and s.p = xor(w.p, 1) where w.n > 1),
v as (select w.r, 0 as l, sub.p, sub.n, w.f, w.proof, sub.h as subroot from w join sub on sub.lang is not distinct from w.lang where w.n = 1
  union all select w.r, w.l + 1, w.p // 2, (w.n + 1) // 2, {node}, w.proof || coalesce(s.h, ''), w.subroot
  from v w left join top s on s.l = w.l and s.p = xor(w.p, 1) where w.n > 1)
select doc_id, leaf, subroot, top.h as root, sha256(v.proof) as proof_sha256, v.f as folded_root, v.f = top.h as verified
from v join leaves using (r) join top on top.n = 1 where v.n = 1"""
