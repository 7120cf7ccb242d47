"""SimHash near-dedup by multi-index hashing.

A fingerprint's 64 bits form two segments of 32. Fingerprints within 3 bits agree on one
segment up to one bit, so each distinct fingerprint is stored under its two segments and
looked up under each segment's Hamming ball of radius 1 (each pair from one side only).
What meets in a bucket is verified on all 64 bits. A bucket yields a spanning forest of its
links, never all its pairs, and exact copies share one entry throughout. A segment that more
than SPLIT distinct fingerprints share, and the segments one bit from it, are split: there the
other half's four bytes, of which one at least is equal in any two that link, form sub-buckets.

Edge cases: a null, empty or blank text has fingerprint zero and links like any other; a
null doc_id takes part but is never a component's least id (a component of null ids only has
component_id null); repeated rows share their component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botledger.llm.common import connected_components, fresh_names, lean, stage_out

MAX_BITS = 3
SHINGLE = 3
#: Distinct fingerprints with one segment beyond which its buckets are split.
SPLIT = 4096
#: Up to this many split buckets are broadcast; more are joined by shuffle.
BROADCAST_SPLIT = 1_000_000
SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's lower-cased word shingles."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    if len(parts) < SHINGLE:
        shingles = [b" ".join(parts)]
    else:
        line, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts])
        starts = np.concatenate(([0], ends[:-1]))[: len(parts) - SHINGLE + 1].tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        shingles = [line[a:z] for a, z in zip(starts, stops)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


@lean
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text")
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype="<u8", count=len(texts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fps.view("<i8"))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


_SEGMENT = {0: "shiftrightunsigned(fp, 32)", 1: "(fp & 4294967295L)"}


def _ball(segment: str, k: int) -> str:
    """SQL of the buckets of a segment with one further bit set."""
    return f"transform(filter(sequence(0, 31), b -> (shiftrightunsigned({segment}, b) & 1L) = 0L), b -> ({segment} | shiftleft(1L, b)) + {k}L * {_HALF}L)"


_HALF = 1 << 32
#: Bits of a bucket; a sub-bucket's number stands above them.
_BUCKET_BITS = 33


def _bucket_entries(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(bucket, fp) of distinct fps: under its own segments, and under each segment with one further bit set."""
    own = ", ".join(f"{s} + {k}L * {_HALF}L" for k, s in _SEGMENT.items())
    balls = ", ".join(_ball(s, k) for k, s in _SEGMENT.items())
    hot = fps.select(F.explode(F.expr(f"array({own})")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split)
    near = F.expr(f"concat(array(bucket), if(bucket < {_HALF}L, {_ball('bucket', 0)}, {_ball(f'(bucket - {_HALF}L)', 1)}))")
    hot = stage_out(hot.select(F.explode(near).alias("bucket")).distinct(), "simhash-hot")
    entries, n_hot = fps.select(F.explode(F.expr(f"concat(array({own}), {balls})")).alias("bucket"), "fp"), hot.count()
    if not n_hot:
        return entries
    hot = hot.withColumn("hot", F.lit(True))
    other = f"if(bucket < {_HALF}L, {_SEGMENT[1]}, {_SEGMENT[0]})"
    sub = f"transform(sequence(0, 3), k -> bucket + shiftleft(1L + k * 256L + (shiftright({other}, k * 8) & 255L), {_BUCKET_BITS}))"
    return entries.join(F.broadcast(hot) if n_hot <= BROADCAST_SPLIT else hot, "bucket", "left").select(
        F.explode(F.expr(f"if(hot, {sub}, array(bucket))")).alias("bucket"), "fp"
    )


def _forest(fps: np.ndarray, own: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Spanning links of one bucket: pairs within MAX_BITS of which one at least is stored here."""
    fps, at = np.unique(fps, return_index=True)
    own = own[at]
    left = np.ones(len(fps), dtype=bool)
    for first in range(len(fps)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo and left.any():
            x = todo.pop()
            rest = np.flatnonzero(left & own) if not own[x] else np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[x]) <= MAX_BITS]
            if len(near):
                out.append((np.full(len(near), fps[x]), fps[near]))
                left[near] = False
                todo.extend(near.tolist())


@lean
def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by bucket; a bucket may run over any number of batches."""
    held_b, held_f = np.empty(0, "<i8"), np.empty(0, "<u8")
    open_parts: list[tuple[np.ndarray, np.ndarray]] = []
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(buckets: np.ndarray, fps: np.ndarray) -> None:
        if len(buckets) < 2:
            return
        seg = np.where((buckets >> 32) & 1 == 0, (fps >> np.uint64(32)).astype("<i8"), (fps & np.uint64(0xFFFFFFFF)).astype("<i8"))
        own = seg == (buckets & 0xFFFFFFFF)
        starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
        sizes = np.diff(np.append(starts, len(buckets)))
        good = (sizes > 1) & np.logical_or.reduceat(own, starts)
        for s, n in zip(starts[good].tolist(), sizes[good].tolist()):
            _forest(fps[s : s + n], own[s : s + n], out)

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            a, b = (np.concatenate(x).view("<i8") for x in zip(*out))
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        b = batch.column("bucket").to_numpy(zero_copy_only=False).astype("<i8")
        f = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
        if not len(b):
            continue
        cut = int(np.searchsorted(b, b[-1], side="left"))
        open_parts.append((b[:cut], f[:cut]))
        if cut or (open_parts[0][0].size and open_parts[0][0][0] != b[-1]):
            held_b, held_f = (np.concatenate(x) for x in zip(*open_parts))
            settle(held_b, held_f)
            open_parts = []
        open_parts.append((b[cut:], f[cut:]))
        yield from flush()
    if open_parts:
        held_b, held_f = (np.concatenate(x) for x in zip(*open_parts))
        settle(held_b, held_f)
    yield from flush()


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): enough links between distinct fingerprints to connect all that lie within MAX_BITS."""
    entries = _bucket_entries(fps.select("fp").distinct(), split)
    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links, "a long, b long")


def components(rows: DataFrame) -> DataFrame:
    """(fp, component_id, keep_id, keep_hash) for each distinct fp of ``rows(doc_id, text_hash, fp)``.

    keep_id and keep_hash name the component's least row, null ids first.
    """
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("keep"))
    roots = connected_components(links(rows), "simhash").withColumnRenamed("node", "fp")
    first = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = first.groupBy("root").agg(F.min("least").alias("component_id"), F.min("keep").alias("keep"))
    return first.select("fp", "root").join(whole, "root").select("fp", "component_id", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_hash").alias("keep_hash"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id, keep_id, keep_hash for every row of docs."""
    rows = stage_out(fingerprints(docs), "simhash-rows")
    return rows.join(components(rows), "fp")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: its least doc_id (null first, then least text hash)."""
    rows = stage_out(fingerprints(docs), "simhash-rows")
    h, keep_id, keep_hash = fresh_names(docs, "h", "keep_id", "keep_hash")
    keep = components(rows).select(F.col("keep_id").alias(keep_id), F.col("keep_hash").alias(keep_hash)).distinct()
    hashed = docs.withColumn(h, F.xxhash64("text"))
    kept = hashed.join(keep, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(h) == F.col(keep_hash)), "left_semi")
    return kept.dropDuplicates(["doc_id", h]).drop(h)
