"""Token-ID output: raw id payloads in shards, each with a minimal perfect hash index of its documents.

File format: a folder of Parquet rows, one per shard (any store Spark can write; the commit
protocol drops what a lost executor left). A row holds the payload, the raw ids of its
documents one after the other in the width named (2 bytes where the vocabulary allows, else
4, little-endian), and the index: the bucket displacements of a minimal perfect hash, and by
its slots a 32-bit fingerprint, the document's offset and length in ids, and its key.
``part`` and ``seq`` order the shards; documents ascend by doc_id over all of them.

Edge cases: a null text counts as empty and has the end id alone; a null doc_id comes first
and is stored as such; rows that repeat a doc_id are stored side by side in order of their
ids and told apart by their turn; other columns are not read; an empty table gives a folder
without shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.llm.bpe import TextEncoder, chunks, load_tokenizer
from botledger.llm.common import lean, stage_out

END_ID = 1
#: Ids in a shard before the next begins.
SHARD_IDS = 2_000_000
#: Up to this many shards (2 MB of numbers) their places are broadcast to the readers; beyond, they are joined by shuffle.
BROADCAST_SHARDS = 100_000
#: Keys to a hash bucket, on average.
BUCKET_KEYS = 3
_SHARD = (
    "part long, seq long, first_key long, last_key long, n_docs long, n_ids long, width int, payload binary, "
    "displacements binary, fingerprints binary, offsets binary, lengths binary, keys binary, nulls binary, turns binary"
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(keys: np.ndarray, nulls: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return _mix(_mix(keys.view("<u8") + np.uint64(0x9E3779B97F4A7C15)) ^ (turns.astype("<u8") * np.uint64(2) + nulls.astype("<u8") + np.uint64(1)))


def _place(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return _mix(h + d.astype("<u8") * np.uint64(0xD1342543DE82EF95)) % np.uint64(n)


def build_mph(h: np.ndarray) -> np.ndarray:
    """Displacements, one per bucket, that send the n distinct hashes to n slots: a value d >= 0 is a
    second hash's seed for the bucket, a negative one the slot (-1 - d) of its only key."""
    n = len(h)
    buckets = max(1, n // BUCKET_KEYS)
    own = (h >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(own, kind="stable")
    sizes = np.bincount(own.astype("<i8"), minlength=buckets)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out, taken = np.zeros(buckets, "<i8"), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable").tolist():
        k = int(sizes[b])
        if k < 2:
            break
        keys, base, step = h[order[starts[b] : starts[b] + k]], 0, 32
        while True:
            spots = _place(keys[None, :], np.arange(base, base + step)[:, None], n).astype("<i8")
            ranked = np.sort(spots, axis=1)
            free = ~taken[spots].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if free.any():
                first = int(np.argmax(free))
                out[b] = base + first
                taken[spots[first]] = True
                break
            base += step
            step = min(4096, step * 2)
    single = np.flatnonzero(sizes == 1)
    out[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return out


def mph_slots(h: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    d = displacements[((h >> np.uint64(32)) % np.uint64(len(displacements))).astype("<i8")]
    return np.where(d < 0, -1 - d, _place(h, np.maximum(d, 0), n).astype("<i8"))


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (_mix(h ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _encode(path: str, width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = TextEncoder(path), f"<u{width}"
        end = np.array([END_ID], kind).tobytes()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for at, z in chunks(texts):
                ids, n = encoder.encode(texts[at:z])
                wire, stops = ids.astype(kind).tobytes(), np.cumsum(n).tolist()
                payloads = [wire[width * (s - k) : width * s] + end for s, k in zip(stops, n.tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, z - at), pa.array(payloads, pa.binary())], ["doc_id", "ids"])

    return run


def _shard(part: int, seq: int, width: int, ids: list[bytes], keys: list) -> tuple:
    n = len(ids)
    nulls = np.array([k is None for k in keys], "u1")
    nums = np.array([k or 0 for k in keys], "<i8")
    turns = np.zeros(n, "<i8")
    same = np.flatnonzero((nums[1:] == nums[:-1]) & (nulls[1:] == nulls[:-1])) + 1
    for i in same.tolist():
        turns[i] = turns[i - 1] + 1
    lengths = np.array([len(x) // width for x in ids], "<i8")
    offsets = np.cumsum(lengths) - lengths
    h = _hash(nums, nulls, turns)
    displacements = build_mph(h)
    back = np.empty(n, "<i8")
    back[mph_slots(h, displacements, n)] = np.arange(n)
    cols = (displacements, _fingerprint(h)[back], offsets[back], lengths[back], nums, nulls, turns)
    return (part, seq, keys[0], keys[-1], n, int(lengths.sum()), width, b"".join(ids), *(c.tobytes() for c in cols))


def _build(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, keys, size = TaskContext.get().partitionId(), 0, [], [], 0
        types = [pa.int64()] * 6 + [pa.int32()] + [pa.binary()] * 8
        names = [c.split()[0] for c in _SHARD.split(", ")]

        def emit() -> pa.RecordBatch:
            row = _shard(part, seq, width, ids, keys)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for b in batches:
            for key, own in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                ids.append(own)
                keys.append(key)
                size += len(own) // width
                if size >= SHARD_IDS:
                    yield emit()
                    seq, ids, keys, size = seq + 1, [], [], 0
        if ids:
            yield emit()

    return run


def write(docs: DataFrame, folder: str, path: str) -> None:
    """Encode every text, append END_ID, and write the shards in ascending doc_id order."""
    width = 2 if load_tokenizer(path).get_vocab_size() <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = stage_out(rows.mapInArrow(_encode(path, width), "doc_id long, ids binary"), "tokens")
    # the start of the ids parts rows that share a doc_id, null above all
    ordered = coded.repartitionByRange("doc_id", F.expr("substring(ids, 1, 16)")).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_build(width), _SHARD).write.option("compression", "zstd").parquet(folder)


def _read_rows(digest: bool):
    """Every document of each shard, found by its key through the index."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                keys, nulls, turns = np.frombuffer(s["keys"], "<i8"), np.frombuffer(s["nulls"], "u1"), np.frombuffer(s["turns"], "<i8")
                at, length = find(s, keys, nulls, turns)
                ids = np.frombuffer(s["payload"], f"<u{s['width']}").astype("<u4").tobytes()
                own = (ids[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist()))
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array(list(own), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=nulls.astype(bool)), pa.array(at + s["base"]), pa.array(length), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def find(shard: dict, keys: np.ndarray, nulls: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of each key's ids in a shard; -1 where the stored fingerprint says the key isn't there."""
    h, n = _hash(keys, nulls, turns), shard["n_docs"]
    slot = mph_slots(h, np.frombuffer(shard["displacements"], "<i8"), n)
    hit = np.frombuffer(shard["fingerprints"], "<u4")[slot] == _fingerprint(h)
    return tuple(np.where(hit, np.frombuffer(shard[c], "<i8")[slot], -1) for c in ("offsets", "lengths"))


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (unsigned 32-bit; with digest their crc32 as ids_crc32) of every document, from the files."""
    shards = spark.read.schema(_SHARD).parquet(folder)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inner = sizes.withColumn("inner", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    base = inner.join(parts, "part").select("part", "seq", (F.col("inner") + F.col("before")).alias("base"))
    side = F.broadcast(base) if sizes.count() <= BROADCAST_SHARDS else base
    return shards.join(side, ["part", "seq"]).mapInArrow(
        _read_rows(digest), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    )


_FOUND = "doc_id long, ids binary"


def _locate(wanted: np.ndarray):
    """The given keys (sorted) that a shard holds, each found at its own slot of the index."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                low = -(1 << 63) if s["first_key"] is None else s["first_key"]
                own = wanted[np.searchsorted(wanted, low) : np.searchsorted(wanted, s["last_key"], side="right")] if s["last_key"] is not None else wanted[:0]
                none = np.zeros(len(own), "<i8")
                at, n = find(s, own, none.astype("u1"), none)
                width = s["width"]
                ids = [s["payload"][width * a : width * (a + k)] if a >= 0 else None for a, k in zip(at.tolist(), n.tolist())]
                found = pa.array([np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in ids if x is not None], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own[at >= 0], pa.int64()), found], ["doc_id", "ids"])

    return run


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit) of the given documents that the store has, in two jobs whatever their number.

    The key ranges alone say which shards may hold a key; of these the payloads are read (the filter
    on part and first_key goes to the scan), and each key is found by one step of the shard's index.
    """
    wanted = np.unique(np.array(doc_ids, "<i8"))
    shards = spark.read.schema(_SHARD).parquet(folder)
    if not len(wanted):
        return shards.where("false").mapInArrow(_locate(wanted), _FOUND)

    @lean
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = (b.column(c).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for c in ("first_key", "last_key"))
            yield b.filter(pa.array(np.searchsorted(wanted, low) < np.searchsorted(wanted, high, side="right")))

    hits = shards.select("part", "seq", "first_key", "last_key").mapInArrow(near, "part long, seq long, first_key long, last_key long").collect()
    keys = sorted({r["first_key"] for r in hits if r["first_key"] is not None})
    first = F.col("first_key").isNull() if any(r["first_key"] is None for r in hits) else F.lit(False)
    held = shards.where(F.col("part").isin(sorted({r["part"] for r in hits})) & (first | F.col("first_key").isin(keys)))
    return held.mapInArrow(_locate(wanted), _FOUND)


def get(spark: SparkSession, folder: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of the given documents as lists; of rows that repeat a doc_id, the first."""
    return {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in lookup(spark, folder, doc_ids).collect()}
