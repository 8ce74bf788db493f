"""Near copies by segment counts: a grid join of set embeddings, an exact check, then components.

A text is the set of its five-word sequences (hashed), read as a very long bit vector of 2^40 segments.
It is embedded as its counts of bits in the segments: the Manhattan distance of two such points bounds
the distance of the sets from below, and two sets of similarity t (shared sequences through all
sequences of both) lie within (1 - t) / (1 + t) times the sum of their sizes. The grid join finds all
pairs within this radius: segments are dealt over blocks, of which at most ``radius`` differ between
two such texts, so among the ``radius + 1`` first blocks of each, in any one order of all block points,
there is one where both have the same point. The order puts points of common sequences last; which ones
count as common decides only the cost. What meets is filtered by the Manhattan bound over 256 coarse
segments, and what that leaves is verified exactly.

Points that many texts share are not compared in pairs. Each has one leader, whose near copies are one group with it. What
is not a near copy of it is told apart by its difference from it: two such texts can only be near copies if more than about half
of either difference is in both (``shared_at_least``), so they meet at the rarest parts of these differences, if at all. With a near copy of the
leader such a text must share that much of the near copy's difference, so it meets the rarest parts of that one with all of its own.
Only texts that no chain of links joins yet are compared there, as no other pair changes a group.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from assetloom.llm.common import cut, dealt_out, stored, utf8
from assetloom.operators.components import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Segments whose counts are a text's grid point (as a power of two), and least number of blocks that they are dealt over.
SEGMENT_BITS, LEAST_BLOCKS = 40, 64
#: Texts that share a block's point are compared in pairs up to this many, then by their differences from a leader.
CROWDED = 64
#: Texts of each size that are compared with all others at a part of differences that is crowded as well, in the first round; each round has eight times as many as the one before.
LEADERS, MORE_LEADERS = 2, 8
#: Sequences are counted by segment in one of so many texts, to tell the common ones: those that make up at least
#: one in MOST_COMMON of what was counted, so there are no more of them than that.
SAMPLE = 16
MOST_COMMON = 500_000
#: So many pairs, or numbers of rows, are sent to the texts; more are joined by shuffling these.
SENT_PAIRS, SENT_ROWS = 400_000, 2_000_000
SALTS = 64
#: Texts whose sequences a Python worker holds at once.
ROWS_AT_ONCE = 512
_hash = partial(xxh64_digest, seed=42)


def shingles(raw: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted hashes of a text's word sequences. Fewer words are one sequence; no words none."""
    split = raw.lower().split()
    grams = map(b" ".join, zip(*(split[i:] for i in range(words)), strict=False)) if len(split) >= words else [b" ".join(split)] if split else []
    return np.unique(np.frombuffer(b"".join(map(_hash, grams)), dtype=">i8").astype(np.int64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared through all sequences; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _parts(batches):
    """Arrow's batches hold up to 10,000 rows, here whole texts; their sets are made for a few at a time."""
    for batch in batches:
        for start in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)
    # Workers live on; what Arrow keeps for later would stay theirs.
    pa.default_memory_pool().release_unused()


def _raw(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def profile(own: np.ndarray) -> bytes:
    """The size as eight bytes, then how many hashes fall in each of 256 classes, 255 at most."""
    return np.int64(len(own)).tobytes() + np.minimum(np.bincount(own & 255, minlength=256), 255).astype(np.uint8).tobytes()


def parity(own: np.ndarray) -> list[int]:
    """Whether the count of each of the 256 classes is odd, as four longs. Two sets differ in at least as many
    sequences as their parities differ in bits."""
    return np.packbits(np.bincount(own & 255, minlength=256).astype(np.uint8) & 1).view(">i8").astype(np.int64).tolist()


def _node_batches(batches, place, words):
    for batch in _parts(batches):
        sets = [shingles(x, words) for x in _raw(batch.column(place))]
        nodes = [xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64()), pa.array(list(map(profile, sets)), pa.binary()), pa.array(list(map(parity, sets)), pa.list_(pa.int64()))], [*batch.schema.names, "near_node", "near_profile", "near_parity"])


def _shingle_batches(batches, words):
    for batch in _parts(batches):
        found = [segments(shingles(x, words)) for x in _raw(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["cell"])


def segments(own: np.ndarray) -> np.ndarray:
    """The segment in which each hash's bit lies."""
    return own & ((1 << SEGMENT_BITS) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Weights of segments: a block's counts, each times its segment's weight, add up to the block's point in one long."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.int64)


def grids(n: int, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """(top, radius) of each grid on which a set of ``n`` sequences meets others.

    The grid of a power of two, ``top``, joins sets of more than half as many sequences and up to so many with one another
    and with lesser ones that reach up to them; none in it at ``least`` is farther than the radius.
    """
    top, most, found = 1 << max(n - 1, 0).bit_length(), int(n / least + 1e-6), []
    while True:
        found.append((top, int((1 - least) / (1 + least) * (n + min(most, top)) + 1e-6)))
        if most <= top:
            return found
        top *= 2


def grid_points(own: np.ndarray, rank: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(block points, their ranks) at which the set meets every other at ``least``, but for itself.

    rank: how common each sequence's segment is. Block points are listed by the rank of their rarest segment, then by
    value, and those of blocks without any sequence come last.
    """
    at, points, ranks = segments(own), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    weight = _mixed(at)
    for top, radius in grids(len(own), least):
        if radius == 0:
            continue
        blocks = max(LEAST_BLOCKS, top)
        block = at & (blocks - 1)
        order = np.argsort(block)
        block = block[order]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        point = np.add.reduceat(weight[order], starts) + _mixed(np.array([-top]))
        rarest = np.minimum.reduceat(rank[order], starts)
        first = np.lexsort((point, rarest))[: radius + 1]
        points.append(point[first])
        ranks.append(rarest[first])
        if len(first) <= radius:
            bare = np.setdiff1d(np.arange(blocks), block)[: radius + 1 - len(first)]
            points.append(_mixed(-(top << SEGMENT_BITS // 2) - 1 - bare))
            ranks.append(np.full(len(bare), np.iinfo(np.int64).max))
    return np.concatenate(points), np.concatenate(ranks)


def _point_batches(batches, common, words, least):
    known, counts = common.value
    for batch in _parts(batches):
        found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0), np.zeros(0, bool)]]
        for node, raw in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), strict=True):
            own = shingles(raw, words)
            at = np.minimum(np.searchsorted(known, segments(own)), len(known) - 1)
            rank = np.where(known[at] == segments(own), counts[at], 0)
            points, ranks = grid_points(own, rank, least)
            n = len(points)
            found.append([points, np.full(n, node), np.full(n, len(own)), np.full(n, (rank == 0).mean() if len(own) else 1.0), ranks > 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.float32(), pa.bool_()), strict=True)], ["cell", "node", "size", "own", "known"])


def _profile_batches(batches, least):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 264) for k in (2, 3))
        size = sum(np.ascontiguousarray(x[:, :8]).view(np.int64)[:, 0] for x in (a, b))
        apart = np.abs(a[:, 8:].astype(np.int16) - b[:, 8:]).sum(axis=1)
        yield batch.select([0, 1]).filter(pa.array(apart <= (1 - least) / (1 + least) * size + 1e-6))


def _alike_batches(batches, words, least):
    for batch in _parts(batches):
        kept = [similarity(shingles(a, words), shingles(b, words)) >= least - 1e-12 for a, b in zip(_raw(batch.column(2)), _raw(batch.column(3)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def shared_at_least(apart: int, size: int, leader: int, least: float = SIMILARITY) -> int:
    """How many sequences of its difference from a leader a text x shares with that of every near copy y that is not near the leader.

    apart: size of the difference (sequences in one of the two only). With r = (1 - least) / (1 + least), near copies x and y
    differ in r (x + y) sequences at most, y and the leader l in more than r (y + l), and the differences from l share
    half of what both hold beyond that of x and y: more than (apart + r (l - x)) / 2, whatever y is, and whether x is near the leader or not.
    """
    t = Fraction(least).limit_denominator(1_000_000)
    r = (1 - t) / (1 + t)
    return (apart * r.denominator + r.numerator * (leader - size)) // (2 * r.denominator) + 1


def _difference_batches(batches, words, least, of_near=False):
    """A row without a cell for each near copy of its leader u, else one for each sequence of the difference; with ``of_near`` the latter for all."""
    leader = lru_cache(8)(partial(shingles, words=words))
    for batch in _parts(batches):
        found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int64), np.zeros(0, bool)]]
        for u, v, led, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _raw(batch.column(2)), _raw(batch.column(3)), strict=True):
            first, own = leader(led), shingles(raw, words)
            near = not of_near and similarity(first, own) >= least - 1e-12
            apart = np.zeros(1, np.int64) if near else np.setxor1d(first, own, assume_unique=True)
            n = len(apart)
            cell = _mixed(apart + _mixed(np.array([u])))
            found.append([np.full(n, u), np.full(n, v), cell, np.full(n, 0 if near else shared_at_least(n, len(own), len(first), least)), np.full(n, near)])
        u, v, cell, shared, near = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(cell, pa.int64(), mask=near), pa.array(shared, pa.int32())], ["u", "v", "cell", "shared"])


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text")
    counts = stored(some.mapInArrow(partial(_shingle_batches, words=words), "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED // SAMPLE), "near-common")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * MOST_COMMON >= total).select("cell", "n").toArrow()
    cell, n = (np.concatenate([x.to_numpy(), np.zeros(int(len(x) == 0), np.int64)]) for x in found.columns)
    order = np.argsort(cell)
    return cell[order], n[order]


def near_links(texts: DataFrame, words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """Verified links (u, v), u before v, between the rows of ``texts`` (node long, text binary, profile, parity; nodes distinct).

    Their components are those of all pairs at ``least``. Each such pair is a link where the block points that it shares have at
    most ``CROWDED`` texts. At fuller ones all are compared with the first text there, the leader (texts come in the order of the share of
    their sequences that isn't common, then of their nodes). Then texts meet by their differences from it, both not near it or one of them,
    and are compared unless links join them already: in pairs, or where more than ``CROWDED`` meet in rounds, in each of which
    some are compared with all others there, until links join all there or each was compared.
    """
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, words))
    cells = texts.select("node", "text").mapInArrow(partial(_point_batches, common=common, words=words, least=least), "cell long, node long, size int, own float, known boolean")
    # Points known to be common are salted here and counted afterwards, so that none of them is one window.
    salt = F.when(F.col("known"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0)
    cells = stored(cells.withColumn("salt", salt).withColumn("n", F.count("*").over(Window.partitionBy("cell", "salt"))).where("known or n > 1").drop("salt"), "near-cells")
    shared = cells.where("known").groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    cells = cells.where("not known").drop("known").unionByName(stored(cells.where("known").drop("known", "n").join(dealt_out(shared), "cell"), "near-known"))

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(ours: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs at one block point, if their sizes allow the similarity, and the parities (if known) are near; of rows with
        a root and a side, those that no links join and that are on two sides, if they are on any."""
        before = (F.col("own_x") < F.col("own")) | ((F.col("own_x") == F.col("own")) & (F.col("node_x") < F.col("node")))
        near = before if ours is others else F.col("node_x") != F.col("node")
        ours = ours.select([F.col(c).alias(c if c == "cell" else f"{c}_x") for c in ours.columns])
        both = F.col("size") + F.col("size_x")
        near = near & (F.least("size", "size_x") + 1e-6 >= least * F.greatest("size", "size_x"))
        if "parity" in others.columns:
            apart = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity_x")[i])) for i in range(4)), F.lit(0))
            near = near & (apart <= (1 - least) / (1 + least) * both + 1e-6)
        if "root" in others.columns:
            near = near & (F.col("root_x") != F.col("root")) & ((F.col("side_x") != F.col("side")) | (F.col("side") == 0))
        pairs = ours.join(others, "cell").where(near)
        u, v = (F.when(before, F.col(a)).otherwise(F.col(b)) for a, b in (("node_x", "node"), ("node", "node_x")))
        return pairs.select(u.alias("u"), v.alias("v")).distinct()

    def with_sides(pairs: DataFrame, few: bool, what: str) -> DataFrame:
        """The pairs with a column of both texts. Few pairs are sent to the texts, so that only theirs are shuffled."""
        for k in ("u", "v"):
            side = texts.select(F.col("node").alias(k), F.col(what).alias(f"{k}_{what}"))
            pairs = pairs.join(side.join(F.broadcast(pairs.select(k).distinct()), k, "left_semi") if few else side, k)
        return pairs.select("u", "v", f"u_{what}", f"v_{what}")

    def few_files(df: DataFrame, n: int) -> DataFrame:
        """Small tables in few partitions: each of theirs would be a file of its own in every exchange."""
        return df.coalesce(max(1, min(tasks, n // 1000)))

    def verified(pairs: DataFrame) -> DataFrame:
        near = cut(pairs)
        n = near.count()
        near = few_files(near, n)
        if n > SENT_PAIRS // 80:  # for a few pairs the whole sets are compared at once
            near = cut(with_sides(near, n <= SENT_PAIRS, "profile").mapInArrow(partial(_profile_batches, least=least), "u long, v long"))
        return cut(with_sides(near, near.count() <= SENT_PAIRS, "text").mapInArrow(partial(_alike_batches, words=words, least=least), "u long, v long"))

    some = cells.where(F.col("n") <= CROWDED)
    links = verified(met(some, some))

    def differences(pairs: DataFrame, of_near: bool) -> DataFrame:
        n = pairs.count()
        made = partial(_difference_batches, words=words, least=least, of_near=of_near)
        return stored(with_sides(few_files(pairs, n), n <= SENT_PAIRS, "text").mapInArrow(made, "u long, v long, cell long, shared int"), "near-differences")

    def rooted(rows: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
        """The rows with the least text that links join to theirs."""
        return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))

    def rarest(parts: DataFrame, counts: DataFrame) -> DataFrame:
        """(cell, node): all but ``shared`` - 1 of each text's parts that are in ``counts``, rarest first; whoever has too few is done."""
        parts = parts.join(dealt_out(counts), "cell").groupBy("u", "v", "shared").agg(F.array_sort(F.collect_list(F.struct("n", "cell"))).alias("parts"))
        first = F.slice("parts", 1, F.size("parts") - F.col("shared") + 1)
        return parts.where("size(parts) >= shared").select(F.col("v").alias("node"), F.explode(first).alias("part")).select("part.cell", "node")

    crowded = cells.where(F.col("n") > CROWDED).select("cell", "node", "size", "own")
    if crowded.isEmpty():
        return links
    crowded = stored(crowded, "near-crowded")
    lead = crowded.groupBy("cell").agg(F.min_by("node", F.struct("own", "node")).alias("u"))
    pairs = cut(crowded.select("cell", F.col("node").alias("v")).join(dealt_out(lead), "cell").where("u <> v").select("u", "v").distinct())
    found = differences(pairs, False)
    led = cut(found.where("cell is null").select("u", "v"))
    links = cut(links.union(led).distinct())
    roots = cut(connected_components(links))

    # Parts that only texts of one root have are shared by none of two roots.
    parts = stored(rooted(rooted(found.where("cell is not null"), roots, "v"), roots, "u", "root_u"), "near-parts")
    mixed = parts.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell", "n")
    meet = rarest(parts, mixed).withColumn("side", F.lit(0))
    # Texts that are near the leader meet those that links don't join to it.
    apart = parts.where("root <> root_u")
    near = led.join(dealt_out(apart.select("u").distinct()), "u", "left_semi")
    close = cut(rarest(differences(cut(near), True), apart.groupBy("cell").agg(F.count("*").alias("n"))))
    beyond = apart.select("cell", F.col("v").alias("node")).join(dealt_out(close.select("cell").distinct()), "cell", "left_semi")
    for side, some in ((1, close), (2, beyond)):
        meet = meet.union(some.select(F.bitwise_not("cell").alias("cell"), "node", F.lit(side).alias("side")))
    meet = cut(meet)
    shared = meet.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    about = rooted(crowded.dropDuplicates(["node"]).drop("cell").join(texts.select("node", "parity"), "node"), roots)
    meet = stored(meet.join(dealt_out(shared), "cell").join(about, "node"), "near-meet")
    some = meet.where(F.col("n") <= CROWDED).drop("n")
    links = cut(links.union(verified(met(some, some))))

    open_, leaders = meet.where(F.col("n") > CROWDED).drop("n"), LEADERS
    while not open_.isEmpty():
        open_ = cut(rooted(open_.drop("root"), connected_components(links)))
        mixed = open_.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
        open_ = cut(open_.join(dealt_out(mixed), "cell", "left_semi"))
        open_ = few_files(open_, open_.count())
        like = [F.floor(F.log("size") / math.log(1 / least)).alias("sizes"), F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("part")]
        lead = cut(open_.groupBy("cell", *like).agg(F.min_by("node", F.struct("own", "node")).alias("node")).select("cell", "node"))
        links = links.union(verified(met(open_.join(lead, ["cell", "node"], "left_semi"), open_)))
        links = cut(few_files(links, links.count()))
        open_ = cut(open_.join(lead, ["cell", "node"], "left_anti"))
        leaders *= MORE_LEADERS
    return links


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, which are joined by chains of pairs at ``least``; no two rows that stay have it.

    Rows with the same set of sequences keep the one with the least doc_id (null last), then text; of
    a group of unlike sets one stays whatever the ids are. Ids may be null or repeat; rows are told
    apart by their contents. Texts without words are one group. Columns may have any names but
    near_row, near_node, near_profile and near_parity.
    """
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = docs.mapInArrow(partial(_node_batches, place=columns.index("text"), words=words), f"{fields}, near_node long, near_profile binary, near_parity array<bigint>")
    marked = stored(marked.withColumn("near_row", F.monotonically_increasing_id()), "near-marked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "near_row")
    first = cut(marked.groupBy("near_node").agg(F.min(order).alias("first")).select("near_node", F.col("first.near_row").alias("near_row")))

    def rows_of(some: DataFrame) -> DataFrame:
        """Few row numbers are sent to the rows, so that no text is shuffled."""
        return marked.join(F.broadcast(some) if some.count() <= SENT_ROWS else some, "near_row", "left_semi")

    one = rows_of(first.select("near_row"))
    links = near_links(one.select(F.col("near_node").alias("node"), utf8(F.col("text")).alias("text"), F.col("near_profile").alias("profile"), F.col("near_parity").alias("parity")), words, least)
    gone = connected_components(links).where("node <> root").select(F.col("node").alias("near_node"))
    return rows_of(cut(first.join(gone, "near_node", "left_anti").select("near_row"))).select(columns)
