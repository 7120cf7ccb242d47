"""Embedding near-dedup by NN-descent.

Equal vectors become one node. A first neighbour graph comes from blocks of random-hyperplane
codes; NN-descent then refines it: the vectors around each node (its neighbours and a sample of
the nodes that list it) are compared with each other, and what beats a list's worst entry
replaces it, until few entries change. Edges at or above the threshold, in double precision,
are kept. Lists full of such edges are saturated: what they had no room for may lie in another
component, so components with a saturated list are compared with each other, in pairs of blocks
whose centres meet in a bucket of hyperplane codes (one bucket up to CENTRES blocks; beyond, tables
enough for a chance of MEET_BALLS) and whose centres and radii allow a link, and join where there is
one; no block meets all others, so this grows with the blocks. Their links are then counted
whole, by pairs of blocks: of pairs so close that all rows link the copies are added unseen, pairs
too far apart are passed over, the rest is compared row by row, so no list length bounds the links
counted. A sample of nodes is compared with all nodes, and grows until AUDIT of them have a link;
where the recall of all their links, or its mean over those nodes, is below MIN_RECALL the build is
repeated with twice the list length and more codes; after BUILDS builds a recall below LEAST_RECALL
is an error. Where links are so rare that the largest sample shows too few to say, builds are
repeated until one finds no more than the last. Links and recall of each build go to the log.
Tables of codes grow with the bits of a code, so larger inputs don't thin the first graph.

The index covers every node. Bounded samples: AUDIT_MOST nodes for the recall audit.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (0 links, their own component, kept); vectors of different lengths do not link; a null
vec_id takes part, is no component's least id, and is not kept; rows that repeat a vec_id
count one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botledger.llm.common import connected_components, drop_table, lean, scratch_scope, stage_out

THRESHOLD = 0.9
#: Neighbours in a list, tables of codes for the first graph, rows of a first block.
LIST = 10
TABLES = 3
#: Chance, at least, that a pair at the threshold has an equal code in one of the tables.
MEET = 0.5
BLOCK = 192
#: Rounds of descent at most, and the share of list entries below which it ends.
ROUNDS = 5
SETTLED = 0.002
#: Rows of a block when whole components are compared.
WHOLE_BLOCK = 512
#: Code bits that part a component into blocks of near vectors, and centres of blocks compared at once.
PART_BITS = 16
CENTRES = 2048
#: Chance, at least, that the centres of two blocks of mean width a link apart meet in a bucket, the angle beyond which it is not kept up, and the first of their tables of codes.
MEET_BALLS = 0.95
MOST_APART = math.pi / 3
BALL_TABLE = 1024
#: Linked nodes that an audit looks for, nodes of its first sample and of its largest, and the recall of links below which the build is repeated.
AUDIT = 256
AUDIT_FIRST = 2048
AUDIT_MOST = 32_768
MIN_RECALL = 0.98
BUILDS = 3
#: Linked nodes below which an audit says nothing, and the recall that is an error after the last build.
AUDIT_LEAST = 32
LEAST_RECALL = 0.9

_log = logging.getLogger(__name__)


def _unit(blobs: pa.Array | list) -> np.ndarray:
    """Unit vectors in double precision from rows of equal length."""
    x = np.array([np.frombuffer(v, "<f8") if not isinstance(v, pa.Scalar) else np.frombuffer(v.as_buffer(), "<f8") for v in blobs])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lean
def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec (its doubles as bytes) of each row, or null where the vector can't be compared."""
    for b in batches:
        out: list[bytes | None] = []
        for v in b.column("embedding").to_pylist():
            x = None if not v or None in v else np.array(v, "<f8") + 0.0
            out.append(None if x is None or not np.isfinite(x).all() or not x.any() else x.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vec"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key at a time, from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(cuts, cuts[1:]):
            if a == 0 and held and held[-1].column(key)[0].as_py() != k[0]:
                yield pa.Table.from_batches(held)
                held = []
            part = b.slice(a, z - a)
            if z < len(k):
                yield pa.Table.from_batches([*held, part])
                held = []
            elif z > a:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _codes(dims_bits: int, tables: int, first_table: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            ids, vecs = b.column("id").to_numpy(zero_copy_only=False), b.column("vec").to_pylist()
            lens = np.array([len(v) for v in vecs])
            for size in np.unique(lens).tolist():
                at = np.flatnonzero(lens == size)
                x = _unit([vecs[i] for i in at])
                for r in range(first_table, first_table + tables):
                    if (size, r) not in planes:
                        planes[size, r] = np.random.default_rng([size, r, 3]).normal(size=(x.shape[1], dims_bits))
                    bits = (x @ planes[size, r] > 0) @ (1 << np.arange(dims_bits, dtype=np.int64))
                    bucket = (np.int64(size // 8 % 100_003) * 4096 + r) * (1 << 34) + bits
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids[at])], ["bucket", "id"])

    return run


_EDGE = "u long, v long, s double"


def _edges(u: list[np.ndarray], v: list[np.ndarray], s: list[np.ndarray], k: int) -> pa.RecordBatch:
    """The k best distinct entries of each node among those gathered: a node that many groups hold sends k rows a batch."""
    u, v, s = (np.concatenate(x) for x in (u, v, s))
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    once = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
    u, v, s = u[once], v[once], s[once]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    return pa.RecordBatch.from_arrays([pa.array(x[rank < k]) for x in (u, v, s)], ["u", "v", "s"])


def _block_neighbours(k: int):
    """The k nearest of each row among the rows of its cell."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ss, n = [], [], [], 0
        for g in _groups(batches, "cell"):
            if g.num_rows < 2:
                continue
            ids, x = g["id"].to_numpy(), _unit(g["vec"].to_pylist())
            for a in range(0, len(ids), 1024):
                sim = x[a : a + 1024] @ x.T
                sim[np.arange(len(sim)), a + np.arange(len(sim))] = -2
                top = min(k, len(ids) - 1)
                near = np.argpartition(-sim, top - 1, axis=1)[:, :top]
                us.append(np.repeat(ids[a : a + 1024], top))
                vs.append(ids[near].ravel())
                ss.append(np.take_along_axis(sim, near, axis=1).ravel())
                n += len(us[-1])
            if n > 50_000:
                yield _edges(us, vs, ss, k)
                us, vs, ss, n = [], [], [], 0
        if us:
            yield _edges(us, vs, ss, k)

    return run


def _local_join(k: int):
    """Pairs among a node's surroundings that beat the worst entry of one of their lists."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ss, n = [], [], [], 0
        for g in _groups(batches, "u"):
            if g.num_rows < 2:
                continue
            ids, x, worst, fresh = g["v"].to_numpy(), _unit(g["vec"].to_pylist()), g["worst"].to_numpy(), g["fresh"].to_numpy(zero_copy_only=False)
            sim = x @ x.T
            a, b = np.nonzero((sim > worst[:, None]) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :]))
            if len(a):
                us.append(ids[a])
                vs.append(ids[b])
                ss.append(sim[a, b])
                n += len(a)
            if n > 50_000:
                yield _edges(us, vs, ss, k)
                us, vs, ss, n = [], [], [], 0
        if us:
            yield _edges(us, vs, ss, k)

    return run


@lean
def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies linked to each node, within one pair of blocks of a component."""
    for g in _groups(batches, "cell"):
        ids, own, x, copies = g["id"].to_numpy(), g["side"].to_numpy(), _unit(g["vec"].to_pylist()), g["copies"].to_numpy()
        one, two = np.flatnonzero(own < 2), np.flatnonzero(own == 2)
        if not len(two):  # a block against itself
            sim = x @ x.T >= THRESHOLD
            np.fill_diagonal(sim, False)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sim @ copies)], ["id", "links"])
        elif len(one):
            sim = x[one] @ x[two].T >= THRESHOLD
            out = np.concatenate((sim @ copies[two], copies[one] @ sim))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[one], ids[two]))), pa.array(out)], ["id", "links"])


@lean
def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre of each block, the largest angle between it and a row, and the copies in it."""
    for g in _groups(batches, "block"):
        x = _unit(g["vec"].to_pylist())
        mean = x.sum(axis=0)
        size = np.sqrt(mean @ mean)
        centre = mean / size if size > 1e-9 else x[0]
        wide = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
        copies = pa.array([int(g["copies"].to_numpy().sum())])
        yield pa.RecordBatch.from_arrays(
            [g["block"][:1].combine_chunks(), g["root"][:1].combine_chunks(), pa.array([centre.tobytes()]), pa.array([wide]), copies], ["block", "root", "centre", "wide", "copies"]
        )


@lean
def _close_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of two components that can hold a link, by the triangle inequality of angles."""
    for g in _groups(batches, "cell"):
        block, root, side, wide, raw = g["block"].to_numpy(), g["root"].to_numpy(), g["side"].to_numpy(), g["wide"].to_numpy(), g["centre"].to_pylist()
        lens = np.array([len(v) for v in raw])
        for size in np.unique(lens).tolist():
            one, two = np.flatnonzero((lens == size) & (side < 2)), np.flatnonzero((lens == size) & (side != 1))
            if not len(one) or not len(two):
                continue
            angle = np.arccos(np.clip(_unit([raw[i] for i in one]) @ _unit([raw[i] for i in two]).T, -1, 1))
            # 1e-6 covers the rounding of arccos near 1
            hit = angle <= math.acos(THRESHOLD) + wide[one][:, None] + wide[two][None, :] + 1e-6
            hit &= root[one][:, None] != root[two][None, :]
            i, j = np.nonzero(hit)
            a, b = block[one][i], block[two][j]
            once = (side[one][i] == 1) | (a < b)
            yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])


@lean
def _sure_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the blocks of a component: for each, the copies in blocks of which all rows link with all of its own (own: 1 if its own do
    with each other), and the pairs (block, other) that may link in part and have to be compared."""
    for g in _groups(batches, "cell"):
        block, side, wide, copies, raw = g["block"].to_numpy(), g["side"].to_numpy(), g["wide"].to_numpy(), g["copies"].to_numpy(), g["centre"].to_pylist()
        x = _unit(raw)
        one, two = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
        if not len(one) or not len(two):
            continue
        angle = np.arccos(np.clip(x[one] @ x[two].T, -1, 1))
        same = block[one][:, None] == block[two][None, :]
        angle[same] = 0
        reach, limit = wide[one][:, None] + wide[two][None, :], math.acos(THRESHOLD)
        # 1e-6 covers the rounding of arccos near 1
        sure, maybe = angle + reach <= limit - 1e-6, angle - reach <= limit + 1e-6
        whole = [(block[one], sure @ copies[two], (sure & same).any(axis=1))]
        if (side == 1).any():
            whole.append((block[two], copies[one] @ sure, np.zeros(len(two), bool)))
        for ids, n, own in whole:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(own.astype("<i8")), pa.nulls(len(ids), pa.int64())], ["block", "sure", "own", "other"])
        i, j = np.nonzero(maybe & ~sure)
        a, b = block[one][i], block[two][j]
        once = (side[one][i] == 1) | (a <= b)
        none = pa.array(np.zeros(int(once.sum()), "<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(a[once]), none, none, pa.array(b[once])], ["block", "sure", "own", "other"])


@lean
def _joined_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The roots of two blocks that hold a link."""
    for g in _groups(batches, "cell"):
        side, root, x = g["side"].to_numpy(), g["root"].to_numpy(), _unit(g["vec"].to_pylist())
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(one) and len(two) and (x[one] @ x[two].T >= THRESHOLD).any():
            yield pa.RecordBatch.from_arrays([pa.array(root[one[:1]]), pa.array(root[two[:1]])], ["a", "b"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """(u, nn): the k best distinct entries of each node, nearest first."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    return once.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "v")), asc=False), 1, k).alias("nn"))


def tables_for(bits: int) -> int:
    """Tables of codes with so many bits in which a pair at the threshold meets with a chance of MEET."""
    same = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(1 - MEET) / math.log(1 - same)))


def code_bits(n: int) -> int:
    return max(1, min(32, math.ceil(math.log2(max(2, n / 64)))))


def neighbour_lists(nodes: DataFrame, n: int, k: int, tables: int) -> DataFrame:
    """(u, nn) for each node with a neighbour: the refined graph."""
    bits = code_bits(n)
    vecs = nodes.select("id", "vec")
    coded = vecs.mapInArrow(_codes(bits, tables, 0), "bucket long, id long")
    big = coded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    cells = coded.join(big, "bucket", "left").select(
        "id", F.xxhash64("bucket", F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.coalesce("m", F.lit(1)) / F.lit(BLOCK)).cast("long"))).alias("cell")
    )
    blocks = cells.join(vecs, "id").repartition("cell").sortWithinPartitions("cell", "id")
    lists = stage_out(_best(blocks.mapInArrow(_block_neighbours(k), _EDGE), k).withColumn("fresh", F.col("nn.v")), "nn-lists")
    for _ in range(ROUNDS):
        fwd = lists.select("u", F.explode("nn.v").alias("v"), "fresh").select("u", "v", F.array_contains("fresh", F.col("v")).alias("fresh"))
        listed = fwd.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
        back = fwd.join(listed, "v").where(F.pmod(F.xxhash64("u", "v"), F.col("deg")) < k)
        near = fwd.unionByName(back.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        active = near.groupBy("u").agg(F.max("fresh").alias("any")).where("any").select("u")
        known = lists.select(F.col("u").alias("v"), F.when(F.size("nn") < k, F.lit(-2.0)).otherwise(F.element_at("nn", -1)["s"]).alias("worst"))
        side = vecs.withColumnRenamed("id", "v").join(known, "v")
        around = near.join(active, "u", "left_semi").join(side, "v").repartition("u").sortWithinPartitions("u", "v")
        found = around.mapInArrow(_local_join(k), _EDGE)
        old = lists.select("u", F.explode("nn").alias("e")).select("u", "e.v", "e.s")
        merged = _best(old.unionByName(found), k)
        before = lists.select("u", F.col("nn.v").alias("had"))
        nxt = stage_out(
            merged.join(before, "u", "left").select("u", "nn", F.array_except("nn.v", F.coalesce("had", F.array().cast("array<bigint>"))).alias("fresh")), "nn-lists"
        )
        lists = nxt
        if (nxt.agg(F.sum(F.size("fresh")).alias("c")).first()["c"] or 0) <= SETTLED * n * k:
            break
    return lists.select("u", "nn")


def _saturated(roots: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(id, root) of all nodes of the components in which a list is saturated."""
    full = lists.where((F.size("nn") >= k) & (F.element_at("nn", -1)["s"] >= THRESHOLD)).select(F.col("u").alias("node"))
    hot = full.join(roots, "node").select("root").distinct()
    return roots.join(hot, "root").select(F.col("node").alias("id"), "root")


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(id, root, vec, copies) dealt to blocks of near vectors of one component, and the ball of each block."""
    bits = members.groupBy("root").agg(F.count(F.lit(1)).alias("m")).select(
        "root", F.least(F.lit(PART_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / F.lit(WHOLE_BLOCK))))).cast("int").alias("bits")
    )
    coded = members.select("id", "vec").mapInArrow(_codes(PART_BITS, 1, 0), "bucket long, id long")
    placed = members.join(bits, "root").join(coded, "id").select("id", "root", "vec", "copies", F.expr("bucket & (shiftleft(1L, bits) - 1)").alias("code"))
    placed = stage_out(placed, "nn-placed")
    parts = placed.groupBy("root", "code").agg(F.ceil(F.count(F.lit(1)) / F.lit(WHOLE_BLOCK)).cast("long").alias("parts"))
    placed = placed.join(parts, ["root", "code"]).select("id", "root", "vec", "copies", F.xxhash64("root", "code", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    balls = placed.repartition("block").sortWithinPartitions("block").mapInArrow(_ball, "block long, root long, centre binary, wide double, copies long")
    return placed, stage_out(balls, "nn-balls")


def ball_codes(n: int, wide: float) -> tuple[int, int]:
    """Bits of a code that part n centres into buckets of CENTRES, and tables in which centres that far apart meet with a chance of MEET_BALLS."""
    bits = max(0, math.ceil(math.log2(max(1, n) / CENTRES)))
    angle = min(MOST_APART, math.acos(THRESHOLD) + 2 * wide)
    same = (1 - angle / math.pi) ** bits
    return bits, 1 if bits == 0 else max(1, math.ceil(math.log(1 - MEET_BALLS) / math.log(1 - same)))


def _deal_balls(balls: DataFrame) -> DataFrame:
    """(cell, block, root, centre, wide, side): the blocks of each bucket of codes of their centres, in chunks of about CENTRES, a cell for each pair of chunks.

    A root with more blocks than that in a bucket has chunks of its own, which don't meet each other: its blocks are joined already.
    So what is dealt grows with the blocks, not with the pairs of components; codes have no bits, and every pair meets, up to CENTRES blocks.
    """
    row = balls.agg(F.count(F.lit(1)).alias("n"), F.avg("wide").alias("wide")).first()
    bits, tables = ball_codes(row["n"], row["wide"] or 0.0)
    centres = balls.select(F.col("block").alias("id"), F.col("centre").alias("vec"))
    coded = centres.mapInArrow(_codes(bits, tables, BALL_TABLE), "bucket long, id long").withColumnRenamed("id", "block")
    coded = coded.join(balls.select("block", "root"), "block")
    of_root = coded.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
    heavy = of_root.where(F.col("m") > CENTRES).select("bucket", "root", F.ceil(F.col("m") / F.lit(CENTRES)).cast("long").alias("own"))
    light = of_root.where(F.col("m") <= CENTRES).groupBy("bucket").agg(F.ceil(F.sum("m") / F.lit(CENTRES)).cast("long").alias("shared"))
    coded = coded.join(heavy, ["bucket", "root"], "left").join(light, "bucket", "left")
    place = F.pmod(F.xxhash64("block"), F.coalesce("own", "shared"))
    coded = coded.select("bucket", "block", F.when(F.col("own").isNotNull(), F.col("root")).alias("owner"), place.alias("place"))
    coded = stage_out(coded.select("bucket", "block", "owner", F.xxhash64("owner", "place").alias("chunk")), "nn-chunks")
    chunks = coded.select("bucket", "chunk", "owner").distinct()
    other = chunks.select("bucket", F.col("chunk").alias("chunk2"), F.col("owner").alias("owner2"))
    pairs = chunks.join(other, "bucket").where("chunk = chunk2 and owner is null or chunk < chunk2 and not coalesce(owner = owner2, false)")
    cell = F.xxhash64("bucket", "chunk", "chunk2").alias("cell")
    ends = F.when(F.col("chunk") == F.col("chunk2"), F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(1).alias("side")), F.struct(F.col("chunk2").alias("chunk"), F.lit(2).alias("side")))
    )
    dealt = pairs.select("bucket", cell, F.explode(ends).alias("x")).select("bucket", "cell", "x.chunk", "x.side")
    return coded.select("bucket", "chunk", "block").join(dealt, ["bucket", "chunk"]).join(balls, "block").select("cell", "block", "root", "centre", "wide", "side")


def _join_components(roots: DataFrame, placed: DataFrame, balls: DataFrame) -> DataFrame:
    """roots with the components in blocks joined where two of them hold a linked pair in blocks whose centres meet in a bucket."""
    met = _deal_balls(balls).repartition("cell").sortWithinPartitions("cell").mapInArrow(_close_balls, "a long, b long")
    close = stage_out(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "nn-close")
    both = close.select(F.xxhash64("a", "b").alias("cell"), F.explode(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side")))).alias("x"))
    pairs = both.select("cell", "x.block", "x.side").join(placed.select("block", "root", "vec"), "block").repartition("cell").sortWithinPartitions("cell", "side")
    linked = stage_out(pairs.mapInArrow(_joined_cells, "a long, b long").distinct(), "nn-joined")
    if linked.isEmpty():
        return roots
    return stage_out(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked), "nn"), "nn-roots")


def _whole_components(placed: DataFrame, balls: DataFrame) -> DataFrame:
    """(id, links) for all nodes of the components in blocks.

    Blocks so close that all their rows link add their copies unseen, blocks too far apart nothing;
    only the pairs of blocks in between are compared row by row.
    """
    chunks = balls.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(CENTRES)).cast("long").alias("chunks"))
    dealt = balls.join(chunks, "root").withColumn("mine", F.pmod(F.xxhash64("block"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "block", "centre", "wide", "copies", F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    told = stage_out(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_sure_balls, "block long, sure long, own long, other long"), "nn-told")
    sure = told.where("other is null").groupBy("block").agg(F.sum("sure").alias("sure"), F.max("own").alias("own"))
    unseen = placed.join(sure, "block").select("id", (F.col("sure") - F.col("own") * F.col("copies")).alias("links"))
    pairs = told.where("other is not null").select(F.xxhash64("block", "other").alias("cell"), F.col("block").alias("a"), F.col("other").alias("b"))
    alone = F.col("a") == F.col("b")
    sides = F.when(alone, F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("block"), F.lit(1).alias("side")), F.struct(F.col("b").alias("block"), F.lit(2).alias("side")))
    )
    cells = pairs.select("cell", F.explode(sides).alias("x")).select("cell", "x.block", "x.side").join(placed.select("block", "id", "vec", "copies"), "block")
    compared = cells.repartition("cell").sortWithinPartitions("cell", "side", "id").mapInArrow(_count_cells, "id long, links long")
    return unseen.unionByName(compared).groupBy("id").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, result: DataFrame, n: int) -> float | None:
    """The lower of: links found over links there are, and the mean of that share over nodes with a link; None if too few have one to say.

    Sampled nodes are compared with all; the sample grows until AUDIT of them have a link, or AUDIT_MOST or all are compared.
    """
    size = AUDIT_FIRST
    while True:
        truth = stage_out(_links_of(nodes, size), "nn-audit")
        share = F.least("truth", F.coalesce("links", F.lit(0)))
        row = truth.where("truth > 0").join(result, "id", "left").agg(
            F.count(F.lit(1)).alias("m"), F.sum("truth").alias("t"), F.sum(share).alias("f"), F.avg(share / F.col("truth")).alias("mean")
        ).first()
        drop_table(truth)
        if row["m"] >= AUDIT or size >= n:  # enough, or all nodes were compared with all
            return min(row["f"] / row["t"], row["mean"]) if row["m"] else 1.0
        if size >= AUDIT_MOST:
            return min(row["f"] / row["t"], row["mean"]) if row["m"] >= AUDIT_LEAST else None
        size = min(4 * size, AUDIT_MOST)


def _links_of(nodes: DataFrame, size: int) -> DataFrame:
    """(id, truth): links of each of a sample of nodes, by comparison with all nodes."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(size).select("id", "vec").collect()
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in sample], np.int64), [bytes(r["vec"]) for r in sample]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_vecs = shared.value
        q_len = np.array([len(v) for v in q_vecs])
        units = {w: _unit([q_vecs[i] for i in np.flatnonzero(q_len == w)]) for w in np.unique(q_len).tolist()}
        total = np.zeros(len(q_ids), np.int64)
        for b in batches:
            own, vs, copies = b.column("id").to_numpy(), b.column("vec").to_pylist(), b.column("copies").to_numpy()
            lens = np.array([len(v) for v in vs])
            for w in np.unique(lens).tolist():
                at, q = np.flatnonzero(lens == w), np.flatnonzero(q_len == w)
                if not len(q):
                    continue
                x = _unit([vs[i] for i in at])
                for j in range(0, len(q), 512):
                    some = q[j : j + 512]
                    hit = units[w][j : j + 512] @ x.T >= THRESHOLD
                    hit &= q_ids[some][:, None] != own[at][None, :]
                    total[some] += hit @ copies[at]
        linked = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[linked]), pa.array(total[linked])], ["id", "truth"])

    return nodes.select("id", "vec", "copies").mapInArrow(run, "id long, truth long").groupBy("id").agg(F.sum("truth").alias("truth"))


def link_nodes(nodes: DataFrame) -> tuple[DataFrame, float | None]:
    """((id, links, root) of every node with a link, audited recall); links counts the rows of other nodes.

    Where links are too rare for an audit, a build counts as whole once another one with twice the codes and list finds no more.
    """
    n, k = nodes.count(), LIST
    tables = tables_for(code_bits(n))
    found = None
    for _ in range(BUILDS):
        result, recall = _build(nodes, n, k, tables)
        links = result.agg(F.sum("links")).first()[0] or 0
        _log.info("links %d, audited recall %s, lists of %d, %d tables of codes", links, recall, k, tables)
        if (recall is None and found is not None and links <= found) or (recall is not None and recall >= MIN_RECALL):
            return result, recall
        found = links
        k, tables = 2 * k, 2 * tables
    if recall is not None and recall >= LEAST_RECALL:
        return result, recall
    raise RuntimeError(f"recall of links is {recall if recall is None else round(recall, 3)} after {BUILDS} builds, below {LEAST_RECALL} or still rising")


def _build(nodes: DataFrame, n: int, k: int, tables: int) -> tuple[DataFrame, float | None]:
    """Links of one build, and their audited recall; tables on the way are dropped."""
    with scratch_scope() as keep:
        lists = neighbour_lists(nodes, n, k, tables)
        near = lists.select("u", F.explode("nn").alias("e")).where(F.col("e.s") >= THRESHOLD).select("u", F.col("e.v").alias("v"))
        near = stage_out(near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "nn-links")
        roots = stage_out(connected_components(near.select(F.col("u").alias("a"), F.col("v").alias("b")), "nn"), "nn-roots")
        listed = near.join(nodes.select(F.col("id").alias("v"), "copies"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("copies").alias("listed"))
        members = stage_out(_saturated(roots, lists, k), "nn-members")
        counted = members.select("id", F.lit(None).cast("long").alias("links"))
        if not members.isEmpty():
            placed, balls = _blocks(members.join(nodes.select("id", "vec", "copies"), "id"))
            roots = _join_components(roots, placed, balls)
            # the blocks stay as they are where components join, under the new root
            counted = _whole_components(placed, balls.join(roots.select(F.col("node").alias("root"), F.col("root").alias("now")), "root").drop("root").withColumnRenamed("now", "root"))
        result = stage_out(
            roots.select(F.col("node").alias("id"), "root").join(listed, "id", "left").join(counted, "id", "left")
            .select("id", F.coalesce("links", "listed", F.lit(0)).cast("long").alias("links"), "root"),
            "nn-result",
        )
        keep(result)
        return result, _audit(nodes, result, n)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows(vec_id, embedding)."""
    vecs = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vecs = stage_out(vecs.mapInArrow(_valid, "vec_id long, vec binary"), "nn-rows")
    good = vecs.where("vec is not null")
    grouped = good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stage_out(grouped.withColumn("id", F.monotonically_increasing_id()), "nn-nodes")
    links, _ = link_nodes(nodes)
    linked = nodes.select("id", "vec", "least", "copies").join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = linked.join(least, "root").select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = good.join(by_node, "vec").select("vec_id", "n_links", "component_id")
    alone = vecs.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
