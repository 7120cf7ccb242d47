"""Hard-negative mining by norm-bucketed search.

Candidates are range-partitioned and sorted by norm, longest first, and packed into buckets of
at most BUCKET rows. Buckets are dealt in turn to trays of about TRAY, so that each tray holds
long and short ones, and blocks of queries go to every tray. A task holds one tray, takes query
blocks one by one, and goes through the tray's buckets from the longest: by Cauchy-Schwarz no row
of a bucket can score above query norm times bucket norm, so a query whose window's lower limit or
running k-th score lies above that is done with the bucket and all later ones. What is left is
scored exactly, in whole numbers. A tray gives at most k rows for each query; a window over
those keeps the best k.

The search runs twice: for an anchor's positives (rows of its label, no window), then for the
negatives of each positive (rows of other labels whose score lies in the window that the positive's
score gives). Anchors are a stated part of the rows; nothing is kept of scores that lose.

Edge cases: rows with a null id, label or vector, or with any null or non-finite component, take
no part; a vector has no score with one of another length; rows that share the anchor's id are no
partners of it; a repeated row counts as often as it stands, and a repeated anchor (id, label and
vector equal) is mined once; a positive score below zero opens no window; an anchor without
positives or negatives has no rows. A component beyond 2^26 after scaling is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.llm import vectors as v
from botledger.llm.common import lean, stage_out

#: Rows of a bucket, buckets of a tray (about), and queries of a block.
BUCKET, TRAY, QUERIES = 4096, 16, 512
SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOWER, UPPER = 30, 90
#: What rounding may take from a norm.
_SLACK = 1 + 1e-9
_FREE = 1 << 62

_PACK = "kind int, dim int, tray int, part int, seq int, norm double, ids binary, labels binary, rows binary, queries binary"
_PACK_ARROW = pa.schema(
    [("kind", pa.int32()), ("dim", pa.int32()), ("tray", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("norm", pa.float64())]
    + [(c, pa.binary()) for c in ("ids", "labels", "rows", "queries")]
)
_CANDIDATES, _QUERIES = 0, 1
#: Of a query: anchor's place in its block, lower and upper limit, the positive's rank, id and score.
_Q = np.dtype([("at", "<i8"), ("low", "<i8"), ("high", "<i8"), ("nth", "<i8"), ("positive", "<i8"), ("score", "<i8")])
_FOUND = "anchor_id long, akey long, nth long, positive_id long, positive_score long, id long, score long"


def prepared(vecs: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, dim, norm, vec, akey) of the rows that take part."""
    good = vecs.where(F.col("vec_id").isNotNull() & label.isNotNull() & v.usable(F.col("embedding")))
    rows = good.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), v.whole_numbers(F.col("embedding"), scale).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("id", "label", F.size("vec").alias("dim"), norm.alias("norm"), "vec", F.xxhash64("id", "label", "vec").alias("akey"))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """(dim, rows): rows of equal dim that follow each other, at most so many at once."""
    held: pa.Table | None = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        held = rows if held is None else pa.concat_tables([held, rows])
        while len(held) > most or (len(held) and held.column("dim")[0] != held.column("dim")[-1]):
            dims = held.column("dim").to_numpy()
            k = min(most, int(np.argmax(dims != dims[0])) if (dims != dims[0]).any() else most)
            yield int(dims[0]), held.slice(0, k).combine_chunks()
            held = held.slice(k)
    if held is not None and len(held):
        yield held.column("dim")[0].as_py(), held.combine_chunks()


def _longs(rows: pa.Table, name: str) -> bytes:
    return rows.column(name).to_numpy().astype("<i8").tobytes()


def _matrix(rows: pa.Table, dim: int) -> np.ndarray:
    vec = rows.column("vec").combine_chunks()
    return v.matrix(vec, dim) if dim else np.zeros((len(rows), 0), np.int64)


@lean
def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for seq, (dim, rows) in enumerate(_runs(batches, BUCKET)):
        made = {"kind": _CANDIDATES, "dim": dim, "tray": 0, "part": part, "seq": seq, "norm": float(rows.column("norm").to_numpy().max()), "ids": _longs(rows, "id"), "labels": _longs(rows, "label")}
        yield pa.RecordBatch.from_pylist([made | {"rows": _matrix(rows, dim).astype("<i4").tobytes(), "queries": None}], schema=_PACK_ARROW)


@lean
def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """norm is that which a candidate must have at least to reach some window of the block."""
    part = TaskContext.get().partitionId()
    for seq, (dim, rows) in enumerate(_runs(batches, QUERIES)):
        windows = rows.column("windows").combine_chunks()
        flat = windows.flatten()
        q = np.zeros(len(flat), _Q)
        q["at"] = np.repeat(np.arange(len(rows)), windows.value_lengths().to_numpy())
        for name in _Q.names[1:]:
            q[name] = flat.field(name).to_numpy()
        norms = rows.column("norm").to_numpy()[q["at"]] * _SLACK
        with np.errstate(divide="ignore"):
            need = np.where(q["low"] <= 0, 0.0, q["low"] / norms)
        made = {"kind": _QUERIES, "dim": dim, "tray": 0, "part": part, "seq": seq, "norm": float(need.min(initial=np.inf)), "ids": _longs(rows, "id"), "labels": _longs(rows, "label")}
        made |= {"rows": _matrix(rows, dim).astype("<i4").tobytes() + _longs(rows, "akey"), "queries": q.tobytes()}
        yield pa.RecordBatch.from_pylist([made], schema=_PACK_ARROW)


class _Bucket:
    def __init__(self, row: dict):
        self.norm, dim = row["norm"], row["dim"]
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.rows = np.frombuffer(row["rows"], "<i4").reshape(len(self.ids), dim)


class _Block:
    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        n = len(self.ids)
        self.akeys = np.frombuffer(row["rows"][-8 * n :], "<i8")
        self.rows = np.frombuffer(row["rows"][: -8 * n], "<i4").reshape(n, row["dim"]).astype(np.int64)
        self.norms = np.sqrt((self.rows.astype(np.float64) ** 2).sum(axis=1)) * _SLACK
        self.queries = np.frombuffer(row["queries"], _Q)


def _search_tray(block: _Block, tray: list[_Bucket], k: int, same: bool) -> pa.RecordBatch:
    """The best k rows of a tray for each query of a block; the tray's buckets come longest first."""
    q = block.queries
    floor = q["low"].copy()  # the window's lower limit, then the running k-th score
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    norms = block.norms[q["at"]]
    for bucket in tray:
        live = np.flatnonzero(norms * bucket.norm * _SLACK >= floor)
        if not len(live):
            break  # later buckets are no longer
        anchors, place = np.unique(q["at"][live], return_inverse=True)
        scores = v.products(block.rows[anchors], bucket.rows.astype(np.int64))
        fits = (bucket.labels == block.labels[anchors][:, None]) == same
        fits &= bucket.ids != block.ids[anchors][:, None]
        for i, row in zip(live.tolist(), place.tolist()):
            s = scores[row]
            hits = np.flatnonzero((s >= floor[i]) & (s <= q["high"][i]) & fits[row])
            if not len(hits):
                continue
            ids, got = np.concatenate((best[i][0], bucket.ids[hits])), np.concatenate((best[i][1], s[hits]))
            if len(got) > k:
                cut = np.partition(got, len(got) - k)[len(got) - k]
                ids, got = ids[got >= cut], got[got >= cut]
            by = np.lexsort((ids, -got))[:k]
            best[i] = (ids[by], got[by])
            if len(by) == k:
                floor[i] = max(floor[i], got[by[-1]])
    n = np.array([len(b[0]) for b in best])
    at = q["at"].repeat(n)
    cols = [block.ids[at], block.akeys[at], *[q[c].repeat(n) for c in ("nth", "positive", "score")]]
    cols += [np.concatenate([b[j] for b in best]) if len(best) else np.empty(0, np.int64) for j in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "akey", "nth", "positive_id", "positive_score", "id", "score"])


def _searched(k: int, same: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tray = None, []
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if here != (here := (row["dim"], row["tray"])):
                    tray = []
                if row["kind"] == _CANDIDATES:
                    tray.append(_Bucket(row))
                elif tray and tray[0].norm * _SLACK >= row["norm"]:
                    yield _search_tray(_Block(row), tray, k, same)

    return run


def _best(buckets: DataFrame, queries: DataFrame, trays: int, k: int, same: bool) -> DataFrame:
    """The best k rows for each query: (anchor_id, akey, nth, positive_id, positive_score, rank, id, score)."""
    n = queries.count()
    dealt = queries.repartition(max(1, -(-n // QUERIES)), "id", "akey").sortWithinPartitions("dim", "id", "akey")
    blocks = stage_out(dealt.mapInArrow(_query_blocks, _PACK), "negatives-queries").withColumn("tray", F.explode(F.sequence(F.lit(0), F.lit(trays - 1))))
    both = buckets.unionByName(blocks).repartition(trays, "dim", "tray").sortWithinPartitions("dim", "tray", "kind", F.col("norm").desc())
    found = both.mapInArrow(_searched(k, same), _FOUND)
    order = W.partitionBy("anchor_id", "akey", "nth").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over prepared() rows, those that is_anchor holds for as anchors.

    A negative fits where lower * positive_score <= 100 * negative_score <= upper * positive_score.
    """
    spark = rows.sparkSession
    order = [F.col("dim"), F.col("norm").desc(), F.col("id")]
    packed = stage_out(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_buckets, _PACK), "negatives-buckets")
    seen = packed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("part"), F.lit(0)).alias("last")).first()
    trays = max(1, -(-seen["n"] // TRAY), min(seen["n"], spark.sparkContext.defaultParallelism))
    # in turn through the partitions' first buckets, then their second ones: a tray gets long and short ones
    buckets = packed.withColumn("tray", ((F.col("seq").cast("long") * (seen["last"] + 1) + F.col("part")) % trays).cast("int"))
    anchors = rows.where(is_anchor).dropDuplicates(["id", "akey"])
    free = F.array(F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(_Q.names[1:], (-_FREE, _FREE, 0, 0, 0))]))
    first = stage_out(_best(buckets, anchors.withColumn("windows", free), trays, positives, same=True), "negatives-positives")  # counted, then joined
    low, high = -F.expr(f"floor(cast(-score * {lower} as decimal(38,0)) / 100)"), F.expr(f"floor(cast(score * {upper} as decimal(38,0)) / 100)")
    window = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.col("rank").cast("long").alias("nth"), F.col("id").alias("positive"), F.col("score").alias("score"))
    windows = first.select(F.col("anchor_id").alias("id"), "akey", window.alias("w")).where("w.low <= w.high").groupBy("id", "akey").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    won = _best(buckets, anchors.join(windows, ["id", "akey"]), trays, negatives, same=False)
    return won.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(vecs: DataFrame) -> DataFrame:
    """The contract's labels and anchors over vecs(vec_id, embedding, label)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(vecs, label), F.col("id") % 100 == 0)
