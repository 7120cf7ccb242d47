"""Centroid clustering by dual-tree Lloyd: a cover tree over vectors against a tree over centroids.

Vectors are whole numbers, so every comparison that decides is exact. A task packs its rows into
blocks of BLOCK vectors and builds a cover tree over each, once; the blocks are a table in the
shared folder. A round broadcasts the centroids, whose number times size is bounded, builds the
same kind of tree over them, and walks both trees of each block together: a pair of nodes whose
least distance lies above another centroid's greatest is cut, a vector node left with one centroid
is assigned whole, and a leaf is compared with the centroids left for it exactly. Tasks add up
their own clusters; one shuffle of at most (centroids x components) rows a task adds these.

Edge cases: vectors that are null, of another size, or hold null or non-finite components take
no part and get no row; repeated rows and equal vectors are so many vectors; fewer vectors than
centroids make one cluster each; ties go to the smaller centroid; rows without an id start no
cluster before all with one have; no vectors give no rows. A component beyond 2^26 after scaling
is an error, since distances are longs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botledger.llm import vectors as v
from botledger.llm.common import drop_table, lean, stage_out

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, "1"
#: Vectors of a block, and of a tree's leaf.
BLOCK, LEAF = 2048, 16
#: Numbers that the centroids may have in all, since each task gets them.
MOST_CENTROID_NUMBERS = 1 << 22
#: Node pairs that are looked at together.
PAIRS = 1 << 15
#: What rounding may add to a distance in doubles.
_SLACK = 1e-9


class Tree(NamedTuple):
    """Nodes in preorder over points in the order of ``order``: a node covers the points from start to stop, none farther than radius from its centre."""

    order: np.ndarray
    centre: np.ndarray  # place of the centre in order
    start: np.ndarray
    stop: np.ndarray
    radius: np.ndarray
    parent: np.ndarray

    def children(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids): the children of node k are ids[first[k]:first[k + 1]]."""
        ids = np.argsort(self.parent[1:], kind="stable") + 1
        return np.searchsorted(self.parent[ids], np.arange(len(self.parent) + 1)), ids


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree: children's centres lie within the node's radius, their points within half of it (a power of two), and their centres farther apart than that."""
    at, order, nodes = points.astype(np.float64), [], []
    stack = [(np.arange(len(at)), None, -1)] if len(at) else []
    while stack:
        idx, dist, parent = stack.pop()
        if dist is None:
            dist = np.sqrt(((at[idx] - at[idx[0]]) ** 2).sum(axis=1))
        radius, here = float(dist.max()), len(nodes)
        nodes.append((idx[0], len(order), len(order) + len(idx), radius * (1 + _SLACK), parent))
        if len(idx) <= leaf or radius == 0:
            order += idx.tolist()
            continue
        reach = 2.0 ** (np.ceil(np.log2(radius)) - 1)
        parts, near = [(idx[dist <= reach], dist[dist <= reach])], dist > reach
        rest, far = idx[near], dist[near]
        while len(rest):
            c = rest[int(far.argmax())]  # the farthest from the node's centre
            own = np.sqrt(((at[rest] - at[c]) ** 2).sum(axis=1))
            close = own <= reach
            mine = np.concatenate(([c], rest[close & (rest != c)]))
            parts.append((mine, None))
            rest, far = rest[~close], far[~close]
        stack += [(i, d, here) for i, d in reversed(parts)]  # preorder: the first child comes off first
    order = np.array(order, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    centre, start, stop, radius, parent = (np.array(x) for x in zip(*nodes)) if nodes else ([],) * 5
    return Tree(order, place[np.asarray(centre, np.int64)], np.asarray(start, np.int64), np.asarray(stop, np.int64), np.asarray(radius, np.float64), np.asarray(parent, np.int64))


class _Centroids:
    """The tree over centroids: every node stands for its centre, which is a centroid; nodes that cover equal ones stand for the least number."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        t = cover_tree(rows, leaf=1)
        self.first, self.ids = t.children()
        self.inner = np.diff(self.first) > 0
        self.radius, self.number = t.radius, t.order[t.centre]
        for k in np.flatnonzero(~self.inner & (t.stop - t.start > 1)):
            self.number[k] = t.order[t.start[k] : t.stop[k]].min()
        self.at = rows[self.number].astype(np.float64)


def _spread(first: np.ndarray, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, child): for each entry of ``of`` its children, with the entry's place."""
    n = first[of + 1] - first[of]
    which = np.repeat(np.arange(len(of)), n)
    return which, ids[np.repeat(first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def assign(points: np.ndarray, tree: Tree, cents: _Centroids) -> np.ndarray:
    """The nearest centroid's number for each point, in the tree's order, by the walk over pairs of nodes."""
    out = np.full(len(points), -1, np.int64)
    if not len(points):
        return out
    first, ids = tree.children()
    leaf, at = np.diff(first) == 0, points[tree.centre].astype(np.float64)
    above = np.full(len(leaf), np.inf)  # no point of the node is farther than this from its nearest centroid
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        q, c = stack.pop()
        if len(q) > PAIRS and q[0] != q[-1]:
            cut = int(np.searchsorted(q, q[len(q) // 2]))  # pairs of one node stay together
            cut = cut or int(np.searchsorted(q, q[0], "right"))
            stack += [(q[:cut], c[:cut]), (q[cut:], c[cut:])]
            continue
        dist = np.sqrt(((at[q] - cents.at[c]) ** 2).sum(axis=1))
        np.minimum.at(above, q, (dist + tree.radius[q]) * (1 + _SLACK))
        live = (dist - tree.radius[q] - cents.radius[c]) * (1 - _SLACK) <= above[q]
        q, c = q[live], c[live]
        opens = cents.inner[c] & ((cents.radius[c] >= tree.radius[q]) | leaf[q])
        head = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        group = np.cumsum(np.concatenate(([0], (q[1:] != q[:-1]).astype(np.int64))))
        any_open = np.logical_or.reduceat(opens, head)[group]
        # where some centroid node is opened, the node waits with the others
        which, child = _spread(cents.first, cents.ids, c[opens])
        nq, nc = np.concatenate((q[any_open & ~opens], q[opens][which])), np.concatenate((c[any_open & ~opens], child))
        sure = ~any_open & (np.bincount(group)[group] == 1) & ~cents.inner[c]
        for node, k in zip(q[sure], cents.number[c[sure]]):
            out[tree.start[node] : tree.stop[node]] = k
        exact = ~any_open & ~sure & leaf[q]
        if exact.any():
            _leaves(points, tree, cents, q[exact], c[exact], out)
        down = ~any_open & ~sure & ~leaf[q]
        which, child = _spread(first, ids, q[down])
        above[child] = np.minimum(above[child], above[q[down][which]])
        nq, nc = np.concatenate((nq, child)), np.concatenate((nc, c[down][which]))
        if len(nq):
            by = np.argsort(nq, kind="stable")
            stack.append((nq[by], nc[by]))
    return out


def _leaves(points: np.ndarray, tree: Tree, cents: _Centroids, q: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
    """Points of leaves against the centroids left for them, exactly; ties go to the smaller number."""
    n = np.where(tree.radius[q] == 0, 1, tree.stop[q] - tree.start[q])  # one of equal points speaks for all
    ends = np.cumsum(n)
    for a in range(0, len(q), 1024):  # so many leaf pairs at once
        z = min(len(q), a + 1024)
        off = ends[a - 1] if a else 0
        p = np.repeat(tree.start[q[a:z]], n[a:z]) + np.arange(off, ends[z - 1]) - np.repeat(ends[a:z] - n[a:z], n[a:z])
        k = np.repeat(cents.number[c[a:z]], n[a:z])
        d = ((points[p] - cents.rows[k]) ** 2).sum(axis=1)
        if a:  # a leaf's pairs may go on from the slice before
            p, k, d = np.concatenate((held[0], p)), np.concatenate((held[1], k)), np.concatenate((held[2], d))
        by = np.lexsort((k, d, p))
        by = by[np.concatenate(([True], p[by][1:] != p[by][:-1]))]
        out[p[by]] = k[by]
        last = p[by] >= tree.start[q[z - 1]]
        last &= p[by] < tree.stop[q[z - 1]]
        held = (p[by][last], k[by][last], d[by][last])
    for node in np.unique(q[tree.radius[q] == 0]):
        out[tree.start[node] : tree.stop[node]] = out[tree.start[node]]


# ------------------------------------------------------------------ blocks as rows

_BLOCK = "ids array<long>, points binary, nodes binary, reach binary"
_BLOCK_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("nodes", pa.binary()), ("reach", pa.binary())])


def _packed(size: int):
    """Rows (id, vec) in blocks with their trees."""
    def block(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        t = cover_tree(points)
        nodes = np.stack([t.centre, t.start, t.stop, t.parent]).astype("<i4")
        row = [pa.array([ids.take(pa.array(t.order)).to_pylist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in (points[t.order].astype("<i4"), nodes, t.radius.astype("<f8"))]]
        return pa.RecordBatch.from_arrays(row, schema=_BLOCK_ARROW)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= BLOCK:
                rows = pa.Table.from_batches(held).combine_chunks()
                for a in range(0, n - n % BLOCK, BLOCK):
                    part = rows.slice(a, BLOCK).combine_chunks()
                    yield block(part.column("id").combine_chunks(), v.matrix(part.column("vec").combine_chunks(), size))
                held = rows.slice(n - n % BLOCK).to_batches()
                n %= BLOCK
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield block(rows.column("id").combine_chunks(), v.matrix(rows.column("vec").combine_chunks(), size))

    return run


def _blocks(b: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for k in range(len(b)):
        points = np.frombuffer(b.column("points")[k].as_py(), "<i4").reshape(-1, size).astype(np.int64)
        nodes = np.frombuffer(b.column("nodes")[k].as_py(), "<i4").reshape(4, -1).astype(np.int64)
        tree = Tree(np.arange(len(points)), nodes[0], nodes[1], nodes[2], np.frombuffer(b.column("reach")[k].as_py(), "<f8"), nodes[3])
        yield b.column("ids").slice(k, 1).flatten(), points, tree


def _sums(rows: np.ndarray):
    """(cluster, n, sums) of a task's vectors, once at its end."""
    k, size = rows.shape

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, n, sums = _Centroids(rows), np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            for _, points, tree in _blocks(b, size):
                own = assign(points, tree, cents)
                by = np.argsort(own, kind="stable")
                kinds, starts = np.unique(own[by], return_index=True)
                sums[kinds] += np.add.reduceat(points[by], starts, axis=0)
                n[kinds] += np.diff(np.append(starts, len(own)))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), pa.array(n[there]), pa.array(sums[there].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    return run


def _placed(rows: np.ndarray):
    """(vec_id, cluster, distance) of each vector."""
    size = rows.shape[1]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = _Centroids(rows)
        for b in batches:
            for ids, points, tree in _blocks(b, size):
                own = assign(points, tree, cents)
                dist = ((points - rows[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(dist)], ["vec_id", "cluster", "distance"])

    return run


def cluster(vecs: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each usable row of vecs(vec_id, embedding), and the centroids, after the rounds.

    Centroids start at the k vectors with the smallest sha256 of ``seed:vec_id``, and move to the floor of their vectors' mean.
    """
    if k * size > MOST_CENTROID_NUMBERS:
        raise ValueError(f"{k} centroids of {size} numbers are more than {MOST_CENTROID_NUMBERS}, which each task gets")
    good = vecs.where(v.usable(F.col("embedding"), size)).select(F.col("vec_id").cast("long").alias("id"), v.whole_numbers(F.col("embedding"), scale).alias("vec"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = good.orderBy(mark.asc_nulls_last(), "vec").limit(k).collect()  # k rows of bounded size
    rows = v.matrix(pa.array([r["vec"] for r in start], pa.list_(pa.float64())), size)
    blocks = stage_out(good.mapInArrow(_packed(size), _BLOCK), "lloyd-blocks")
    if not len(rows):
        return blocks.where("false").selectExpr("cast(null as long) as vec_id", "cast(null as int) as cluster", "cast(null as long) as distance"), rows
    for _ in range(rounds):
        parts = blocks.mapInArrow(_sums(rows), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "x"))
        rows = rows.copy()
        for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # as many rows as the centroids have numbers
            rows[r["cluster"], r["at"]] = r["x"] // r["n"]
    placed = stage_out(blocks.mapInArrow(_placed(rows), "vec_id long, cluster int, distance long"), "lloyd-placed")
    drop_table(blocks)
    return placed, rows


def clustered(vecs: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """cluster() plus cluster_inertia, inertia and centroid_sha256 for each vector."""
    placed, rows = cluster(vecs, k, rounds, size, scale, seed)
    sums = {r["cluster"]: int(r["x"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # k rows at most
    named = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, r)).encode()).hexdigest()) for i, r in enumerate(rows.tolist())]
    frame = placed.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(frame), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
