"""Hard negatives, centroid clustering and line dedup against brute force, on edge cases and on hot keys."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from botledger.llm import hard_negatives, line_dedup, tree_lloyd, vectors
from botledger.llm.common import table

VECS = "vec_id long, embedding array<float>, label int"


def is_usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ---------------------------------------------------------------- 11 hard negatives


def mined_by_brute_force(rows, positives=5, negatives=10):
    own = []
    for i, v, label in rows:
        if i is not None and label is not None and is_usable(v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            own.append((i, label, [math.floor(256 * x) for x in v]))
    out = collections.Counter()
    for i, label, v in {(i, k, tuple(v)) for i, k, v in own if i % 100 == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, k) for j, k, w in own if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)
            for rank, x in enumerate(fits[:negatives], 1):
                out[i, j, rank, x[1], -s, -x[0]] += 1
    return out


def found(frame):
    return collections.Counter(tuple(r) for r in hard_negatives.mined(frame).collect())


def odd_vectors(rng, n=700, size=6):
    rows = [(i, (rng.normal(size=size) * rng.choice([0.01, 0.3, 1, 5])).tolist(), int(rng.integers(0, 4))) for i in range(-200, n)]
    same = [0.5, 0.25, -0.5, 0.1, 0.9, 0.3]
    rows += [(1_000 + i, same, i % 3) for i in range(300)]  # one vector, a third of the rows
    rows += [(2_000, same, 1), (2_000, same, 1), (2_000, [1.0] * 6, 2), (700, None, 1), (800, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (900, [math.nan] + [0.0] * 5, 1), (1_100, [math.inf] + [0.0] * 5, 2)]
    rows += [(1_200, [0.0] * 6, 1), (None, same, 1), (1_300, same, None), (1_400, [1.0, 2.0], 3), (1_401, [1.0, 1.5], 3), (1_402, [0.9, 0.9], 2), (1_500, [], 1), (1_501, [], 2)]
    return rows


@pytest.mark.parametrize("parts", [1, 9])
@pytest.mark.parametrize("bucket", [7, 4096])
def test_hard_negatives(spark, parts, bucket, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "TRAY", 3)
    monkeypatch.setattr(hard_negatives, "QUERIES", 4)
    rows = odd_vectors(np.random.default_rng(4))
    want = mined_by_brute_force([(i, v and [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert found(spark.createDataFrame(rows, VECS).repartition(parts)) == want and len(want) > 200


def test_hard_negatives_of_the_table_and_of_nothing(spark, sf_dir):
    frame = table(spark, sf_dir, "embeddings")
    want = mined_by_brute_force([(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()])
    assert found(frame.select(*frame.columns, F.lit(1).alias("id"), F.lit("x").alias("tray"), F.lit(None).alias("norm"))) == want
    for nothing in ("false", "vec_id % 100 <> 0", "label = 1 and vec_id % 7 <> 0"):
        assert hard_negatives.mined(frame.where(nothing)).count() == 0
    with pytest.raises(Exception, match="don't fit a long"):
        hard_negatives.mined(spark.createDataFrame([(100, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)], VECS)).count()


def test_short_buckets_are_passed_over(monkeypatch):
    """Once a query has its k, buckets that can't reach the k-th score, or a window's lower limit, are not scored."""
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    tray = []
    for b, norm in enumerate([1000.0, 900.0, 20.0, 10.0]):
        rows = np.round(unit(50) * norm).astype("<i4")
        tray.append(hard_negatives._Bucket({"norm": float(norm) + 2, "dim": 8, "ids": np.arange(50 * b, 50 * b + 50).tobytes(), "labels": np.zeros(50, "<i8").tobytes(), "rows": rows.tobytes()}))
    anchors = np.round(unit(3) * 500).astype("<i4")
    free = np.zeros(3, hard_negatives._Q)
    free["at"], free["low"], free["high"] = np.arange(3), -(1 << 62), 1 << 62
    row = {"dim": 8, "ids": (np.arange(3) + 10_000).tobytes(), "labels": np.zeros(3, "<i8").tobytes(), "rows": anchors.tobytes() + np.zeros(3, "<i8").tobytes()}
    scored, plain = [], vectors.products
    monkeypatch.setattr(hard_negatives.v, "products", lambda a, b: scored.append(len(b)) or plain(a, b))
    out = hard_negatives._search_tray(hard_negatives._Block(row | {"queries": free.tobytes()}), tray, 5, True)
    assert len(scored) == 2 and len(out) == 15
    scores = np.concatenate([plain(anchors.astype(np.int64), t.rows.astype(np.int64)) for t in tray], axis=1)
    assert out.column("score").to_pylist() == [s for row in scores for s in sorted(row.tolist(), reverse=True)[:5]]
    high = free.copy()
    high["low"] = 500 * 950  # only the first bucket's norm reaches it
    scored.clear()
    hard_negatives._search_tray(hard_negatives._Block(row | {"queries": high.tobytes()}), tray, 5, True)
    assert len(scored) == 1


# ---------------------------------------------------------------- 12 centroids


def clustered_by_brute_force(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and is_usable(v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    x = np.array([v for _, v in kept], np.int64)
    c = np.array([v for _, v in sorted(kept, key=mark)[:k]], np.int64)
    near = lambda: ((x[:, None] - c) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = near().argmin(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = [int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)]
    own, dist = near().argmin(axis=1), near().min(axis=1)
    mark = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return collections.Counter((kept[i][0], int(j), int(d), int(dist[own == j].sum()), int(dist.sum()), mark[j]) for i, (j, d) in enumerate(zip(own, dist)))


def clusters(frame):
    return collections.Counter(tuple(r) for r in tree_lloyd.clustered(frame).collect())


@pytest.mark.parametrize("parts", [1, 6])
def test_clusters(spark, sf_dir, parts, monkeypatch):
    monkeypatch.setattr(tree_lloyd, "BLOCK", 128)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(size=64) * rng.choice([0, 0.01, 0.5])).tolist()) for i in range(900)]
    rows += [(i, [0.25] * 64) for i in range(2_000, 2_400)]  # a third are one vector, and there are ties
    rows += [(2_000, [0.25] * 64), (None, [0.5] * 64), (3_000, None), (3_001, [1.0] * 63), (3_002, [math.nan] * 64), (3_003, [None] * 64), (3_004, [math.inf] * 64), (3_005, [])]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    exact = [(r["vec_id"], r["embedding"]) for r in made.collect()]
    assert clusters(made.select("*", F.lit(1).alias("cluster"), F.lit("x").alias("id"), F.lit(None).alias("distance"))) == clustered_by_brute_force(exact)
    frame = table(spark, sf_dir, "embeddings").repartition(parts)
    assert clusters(frame) == clustered_by_brute_force([(r["vec_id"], r["embedding"]) for r in frame.collect()])


def test_clusters_of_few_and_none(spark):
    frame = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)] + [(9, None)], "vec_id long, embedding array<float>")
    assert clusters(frame) == clustered_by_brute_force([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    assert clusters(frame.where("vec_id = 9")) == clusters(frame.where("false")) == collections.Counter()
    with pytest.raises(ValueError, match="which each task gets"):
        tree_lloyd.cluster(frame, k=1 << 20)


@pytest.mark.parametrize("seed", range(6))
def test_walks_over_both_trees_assign_as_all_distances_do(seed):
    rng = np.random.default_rng(seed)
    n, k, size = [(1, 1, 3), (500, 40, 2), (2_000, 700, 5), (300, 16, 64), (400, 3, 1), (600, 200, 3)][seed]
    points, cents = rng.integers(-20, 20, (n, size)), rng.integers(-20, 20, (k, size))
    if seed == 5:
        points, cents = points // 10, cents // 10  # many equal points and centroids
    tree = tree_lloyd.cover_tree(points)
    assert sorted(tree.order.tolist()) == list(range(n))
    own = points[tree.order]
    for c, a, z, r in zip(tree.centre, tree.start, tree.stop, tree.radius):
        assert a <= c < z and np.sqrt(((own[a:z] - own[c]) ** 2).sum(axis=1)).max() <= r + 1e-12
    first, ids = tree.children()
    for node in range(len(tree.parent)):
        kids = ids[first[node] : first[node + 1]]
        if len(kids):
            assert tree.centre[kids[0]] == tree.centre[node] and (tree.start[kids[0]], tree.stop[kids[-1]]) == (tree.start[node], tree.stop[node])
            assert (tree.stop[kids[:-1]] == tree.start[kids[1:]]).all()
    got = tree_lloyd.assign(own, tree, tree_lloyd._Centroids(cents))
    assert got.tolist() == ((own[:, None] - cents) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_pruning_leaves_most_pairs_unlooked_at(monkeypatch):
    """In groups that lie apart, most points are assigned by whole nodes."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4_000, 4_000, (16, 64))
    points = centres[rng.integers(0, 16, 2_000)] + rng.integers(-3, 4, (2_000, 64))
    looked, plain = [0], tree_lloyd._leaves
    monkeypatch.setattr(tree_lloyd, "_leaves", lambda p, t, c, q, k, out: looked.__setitem__(0, looked[0] + int((t.stop[q] - t.start[q]).sum())) or plain(p, t, c, q, k, out))
    tree = tree_lloyd.cover_tree(points)
    tree_lloyd.assign(points[tree.order], tree, tree_lloyd._Centroids(centres))
    assert looked[0] < 0.05 * 2_000 * 16


# ---------------------------------------------------------------- 13 lines


def lines_by_brute_force(docs, least=5):
    holders = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add((i is not None, i or 0))
    out = collections.Counter()
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least or max(holders[key(x)]) == (i is not None, i or 0)]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def lines_of(frame):
    return collections.Counter(tuple(r) for r in line_dedup.digests(frame).collect())


def line_documents():
    rng = np.random.default_rng(8)
    long = [f"line {k} " + "x" * (30 + k % 9) for k in range(60)]
    hot = "  The One Line That a Third of All Rows Hold, Somewhere  "
    docs = [(i, "\n".join([hot] * (i % 3 == 0) + [long[k] for k in rng.integers(0, 60, rng.integers(0, 6))] + ["short"] * 2)) for i in range(900)]
    docs += [(2_000 + i, f"{'é' * 39}{'x' * (i % 2)}\t") for i in range(12)]  # 39 code points don't count, in whatever bytes
    docs += [(3_000 + i, " \x0b" + "ÀB" * 20 + "\r\n" + "àb" * 20 + " ") for i in range(6)]  # only A-Z and six kinds of white space
    docs += [(4_000, "\n".join([long[1]] * 9 + [hot])), (4_000, long[2] + "\n" + hot), (4_000, long[2] + "\n" + hot), (None, hot + "\n" + long[3]), (None, long[3]), (None, None), (None, None)]
    docs += [(5_000, None), (5_001, ""), (5_002, "\n\n"), (5_003, "\n".join(f"{k} " + "only here " * 6 for k in range(3_000)) + "\n" + hot)]
    docs += [(6_000 + i, "four documents hold this line, which are too few") for i in range(4)] + [(6_003, "four documents hold this line, which are too few"), (7_000, hot)]
    return docs


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_lines(spark, parts):
    docs = line_documents()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert lines_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)) == lines_by_brute_force(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_of_tables_and_columns(spark, sf_dir, edge_docs, no_docs):
    frame = table(spark, sf_dir, "documents")
    for f in (frame, edge_docs):
        assert lines_of(f) == lines_by_brute_force([(r["doc_id"], r["text"]) for r in f.collect()])
    assert lines_of(no_docs) == collections.Counter()
    odd = frame.select("*", F.lit(1).alias("tag"), F.lit("k").alias("keep"), F.lit(None).alias("doc"), F.lit(2).alias("_tag"), F.lit(3).alias("n_dropped"))
    out = line_dedup.drop_lines(odd)
    assert out.columns == odd.columns
    want = lines_by_brute_force([(r["doc_id"], r["text"]) for r in frame.collect()])
    got = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["tag"], r["keep"], r["_tag"]) for r in out.collect()}
    assert got == {(i, sha, 1, "k", 2) for i, _, _, sha in want}


def test_line_bitmaps(spark):
    docs = line_documents()
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    hot = [r for r in maps if r["doc"] == 5_003]
    assert len(hot) == 1 and hot[0]["n_dropped"] == 1 and len(hot[0]["keep"]) < 60  # 3,001 lines
    text = dict(docs)[5_003]
    assert line_dedup.kept_lines(text, hot[0]["keep"]) == text.rsplit("\n", 1)[0]


def test_line_runs_settle_at_every_cut():
    """A partition's rows in batches of any size give the same rows; cuts within a key leave it to the ends."""
    rng = np.random.default_rng(6)
    rows = sorted(((int(h), 0, int(d), int(t)) for h, d, t in rng.integers(0, 9, (400, 3))), key=lambda r: (r[0], -r[2], r[3]))
    import pyarrow as pa

    def batch(part):
        return pa.RecordBatch.from_pylist([{"h1": a, "h2": b, "doc": d, "tag": t, "places": [0]} for a, b, d, t in part], schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("places", pa.list_(pa.int32()))]))

    def dropped(cuts, sizes):
        told = []
        for a, z in zip([0, *cuts], [*cuts, len(rows)]):
            part, batches = rows[a:z], []
            while part:
                n = int(rng.choice(sizes))
                batches.append(batch(part[:n]))
                part = part[n:]
            told += [r for b in line_dedup._stream(iter(batches)) for r in b.to_pylist()]
        ends = collections.defaultdict(lambda: [0, -1])
        for r in told:
            if r["kind"] == line_dedup.END:
                ends[r["h1"]][0] += r["n"]
                ends[r["h1"]][1] = max(ends[r["h1"]][1], r["doc"])
        gone = [(r["h1"], r["doc"], r["tag"]) for r in told if r["kind"] == line_dedup.DROPPED]
        gone += [(r["h1"], r["doc"], r["tag"]) for r in told if r["kind"] == line_dedup.WAITING and ends[r["h1"]][0] >= 5 and r["doc"] != ends[r["h1"]][1]]
        return collections.Counter(gone)

    docs = collections.defaultdict(set)
    for h, _, d, _ in rows:
        docs[h].add(d)
    want = collections.Counter({(h, d, t) for h, _, d, t in rows if len(docs[h]) >= 5 and d != max(docs[h])})
    same = [k for k in range(1, len(rows)) if rows[k][:3] != rows[k - 1][:3]]  # a document's rows of a key stay together
    for _ in range(30):
        cuts = sorted(rng.choice(same, int(rng.integers(0, 6)), replace=False).tolist())
        assert dropped(cuts, [1, 2, 7, 50]) == want
