"""Substring dedup: relative Lempel-Ziv parsing against an index of reference blocks of the whole corpus.

Every document is cut into blocks at content-chosen anchors: the windows of WINDOW words
whose least ANCHOR-gram hash is the same gram form one block, so equal text gives equal
blocks wherever it stands. The index holds the earliest place of each block, and a block that
an earlier place holds becomes a match: (reference document, reference word, start, length).
Matches with one displacement against one reference join into longer ones. Any block of which
another version with the same anchor exists may share single windows at a factor's boundary;
those windows alone are looked up one by one, and give matches of the same kind.

Each document is then parsed greedily from its first word on: where matches cover the word, the
one that reaches furthest becomes the next factor, else the word is a literal. A block has one
place in the index, its earliest, so a factor is the longest copy of a stretch of that reference,
not of any later copy of it. Matches have WINDOW words at least, so the factors cover exactly the
windows whose word sequence also starts earlier.

Within an Arrow batch repeated blocks are resolved at once, so a passage that a third of the
corpus shares sends one row per batch to the index, not one per document. An anchor that has
many versions in a batch is hot: its blocks are dealt by their own hash, not by the anchor's,
all go to the window check, and a mark tells the anchor's other blocks to go there too.

Equality of words is equality of a 64-bit hash that takes eight bytes at a step through a
mixing that no structure of the text survives (exact for words up to eight bytes of one
length); equality of windows and blocks is equality of two such hashes.

Edge cases: null, empty and blank texts have no words and nothing is removed; a null doc_id
counts as smaller than any other; rows that repeat doc_id and text are one document and get
the same result; equal doc_ids with other texts are ordered by a 64-bit hash of the texts; other
columns are carried by remove_repeats() unchanged, whatever their names, and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botledger.llm.common import fresh_names, lean

WINDOW = 20
ANCHOR = 6
#: Words that a doubled hash covers; windows and blocks are covered by two or three of these.
WIDE = 16
#: Bytes of text hashed at once in a Python worker (more only if one text is longer).
CHUNK_BYTES = 1_000_000
#: Rows of an Arrow batch turned into Python objects at once.
SLICE_ROWS = 500
#: Versions of an anchor in a batch beyond which its blocks are dealt out by block.
HOT_VERSIONS = 64
#: Added to n of the blocks of hot anchors.
HOT = 1000
#: Windows looked up together in the window check.
WINDOWS_AT_ONCE = 200_000
#: Bytes of a word hashed in arrays; longer words are hashed one by one.
ARRAY_WORD = 64
NULL_ID = -(1 << 63)

_Q = np.uint64(0xD1342543DE82EF95)
_SIZE = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _Q + b)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words in each text."""
    buf = b"\n".join(texts) + b"\n" + bytes(8)
    raw = np.frombuffer(buf, dtype=np.uint8)[:-8]
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, lens = edge[0::2], edge[1::2] - edge[0::2]
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))  # eight bytes from each place on
    hashes = lens.astype(np.uint64) * _SIZE
    live = np.arange(len(starts))
    for at in range(0, ARRAY_WORD, 8):
        if at:
            live = live[lens[live] > at]
            if not len(live):
                break
        hashes[live] = _mix(hashes[live] ^ (lanes[starts[live] + at] & _MASKS[np.minimum(lens[live] - at, 8)]))
    for i in np.flatnonzero(lens > ARRAY_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : starts[i] + lens[i]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def _wide(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of 4 and of WIDE words that start at each place."""
    four, h, width = hashes, hashes, 1
    while width < WIDE:
        h = _pair(h[:-width], h[width:])
        width *= 2
        if width == 4:
            four = h
    return four, h


def window_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of WINDOW words."""
    _, wide = _wide(hashes)
    a, b = wide[: WIDE - WINDOW], wide[WINDOW - WIDE :]
    return _pair(a, b), _pair(b, a)


def _least_gram(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the leftmost least value in each run of ``span`` values, by doubling."""
    at, width = np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        width += step
    return at


def blocks(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, block, text number, first window's start, windows) of each block of each text."""
    n = len(hashes)
    empty = tuple(np.empty(0, t) for t in ("<u8", "<u8", "<i8", "<i8", "<i8"))
    if n < WINDOW:
        return empty
    four, wide = _wide(hashes)
    grams = _pair(four[: 4 - ANCHOR], four[ANCHOR - 4 :])
    least = _least_gram(grams, WINDOW - ANCHOR + 1)[: n - WINDOW + 1]
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[: n - WINDOW + 1] == text[WINDOW - 1 :]
    tag = np.where(whole, least, -1)
    cut = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
    stop = np.append(cut[1:], len(tag))
    keep = tag[cut] >= 0
    cut, stop = cut[keep], stop[keep]
    if not len(cut):
        return empty
    at, rest = least[cut], stop - cut - 1 + WINDOW - WIDE  # a block has at most 2 * WINDOW - ANCHOR words: three runs cover it
    body = _pair(_pair(wide[cut], wide[cut + rest // 2]), wide[cut + rest])
    block = _pair(body, ((at - cut) * 64 + rest).astype(np.uint64))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return grams[at], block, text[cut], cut - first[text[cut]], stop - cut


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_BYTES:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, texts[start:]


def chained(owner: np.ndarray, ref: np.ndarray, start: np.ndarray, stop: np.ndarray, ref_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches of an owner against a reference that touch at the same displacement, joined: (index of one, start, stop, ref_start)."""
    shift = ref_start - start
    order = np.lexsort((start, shift, ref, owner))
    owner, ref, start, stop, shift = (x[order] for x in (owner, ref, start, stop, shift))
    if not len(order):
        return order, start, stop, shift
    apart = (owner[1:] != owner[:-1]) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])
    base = np.concatenate(([0], np.cumsum(apart))) * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(base + stop)
    at = np.flatnonzero(np.concatenate(([True], (base + start)[1:] > reach[:-1])))
    last = np.append(at[1:], len(start)) - 1
    return order[at], start[at], reach[last] - base[last], start[at] + shift[at]


def text_tag(text: bytes) -> int:
    """What tells apart texts of one doc_id, or of none: their XXH64, as Spark's xxhash64() has it."""
    return int.from_bytes(xxhash.xxh64_digest(text, 42), "big", signed=True)


#: A block at a place (n windows > 0; n = 0 marks a hot anchor), or a match (n: minus its words; block: the reference's tag).
_ROW = "key long, block long, doc long, tag long, start long, n long, rdoc long, rstart long"
_NAMES = ["key", "block", "doc", "tag", "start", "n", "rdoc", "rstart"]


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    columns = (*columns, *[np.zeros(len(columns[0]), "<i8")] * (len(_NAMES) - len(columns)))
    return pa.RecordBatch.from_arrays([pa.array(c.astype("<i8", copy=False) if c.dtype != np.uint64 else c.view("<i8")) for c in columns], _NAMES)


def _resolved(key: np.ndarray, block: np.ndarray, docs: np.ndarray, tags: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of blocks at places in rows of a batch: the earliest place of each (key, block), and matches for the others.

    Rows of one doc and tag are one document.
    """
    if not len(key):
        return
    order = np.lexsort((tags, docs))
    rank = np.empty(len(docs), "<i8")
    same = np.concatenate(([False], (docs[order][1:] == docs[order][:-1]) & (tags[order][1:] == tags[order][:-1])))
    rank[order] = np.cumsum(~same) - 1
    chosen = np.empty(int(rank.max()) + 1, "<i8")
    chosen[rank] = np.arange(len(docs))
    who = rank[row]
    place = who * (int(start.max()) + 1) + start
    order = np.lexsort((place, key, block))
    key, block, who, start, n, place = (x[order] for x in (key, block, who, start, n, place))
    new = np.concatenate(([True], (block[1:] != block[:-1]) | (key[1:] != key[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(block)), 0))
    later = place > place[first]
    keys, versions = np.unique(key[new], return_counts=True)
    hot = keys[versions > HOT_VERSIONS]
    extra = np.where(np.isin(key[new], hot), HOT, 0)
    at = chosen[who[new]]
    yield _batch(key[new], block[new], docs[at], tags[at], start[new], n[new] + extra)
    if len(hot):
        none = np.zeros(len(hot), "<i8")
        yield _batch(hot, ~hot, none, none, none, none)
    i, begin, end, ref_start = chained(who[later], who[first[later]], start[later], start[later] + n[later] - 1 + WINDOW, start[first[later]])
    at, ref = chosen[who[later][i]], chosen[who[first[later]][i]]
    yield _batch(_mix(docs[at].view("<u8") + begin.astype("<u8")), tags[ref], docs[at], tags[at], begin, begin - end, docs[ref], ref_start)


@lean
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of every text at their earliest places in the batch, and the matches found within it."""
    for b in batches:
        docs = b.column("doc").to_numpy(zero_copy_only=False).astype("<i8")
        tags, found = np.empty(len(docs), "<i8"), []
        for low in range(0, len(docs), SLICE_ROWS):
            texts = [(t or "").encode() for t in b.column("text").slice(low, SLICE_ROWS).to_pylist()]
            tags[low : low + len(texts)] = [text_tag(t) for t in texts]
            for at, part in _chunks(texts):
                anchor, block, text, start, n = blocks(*word_hashes(part))
                found.append((anchor, block, text + low + at, start, n))
        if found:
            anchor, block, text, start, n = (np.concatenate(x) for x in zip(*found))
            yield from _resolved(anchor, block, docs, tags, text, start, n)


@lean
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block, doc, tag, start). Blocks that an earlier place holds become
    matches; the earliest place of each version of an anchor that has several comes out
    as it is (n > 0) for the boundary check. State between batches is two rows."""
    width, out = len(_NAMES), len(_NAMES)
    held: np.ndarray | None = None  # rows, and whether the row is already out
    for b in batches:
        rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _NAMES] + [np.zeros(b.num_rows, "<i8")], axis=1)
        matches = rows[:, 5] < 0
        if matches.any():
            yield _batch(*rows[matches].T[:width])
            rows = rows[~matches]
        if held is not None:
            rows = np.concatenate((held, rows))
        if not len(rows):
            continue
        key, block = rows[:, 0], rows[:, 1]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_block = new_key | np.concatenate(([True], block[1:] != block[:-1]))
        first = np.maximum.accumulate(np.where(new_block, np.arange(len(rows)), 0))
        place = rows[:, 5] > 0
        later = (rows[:, 2:5] != rows[first, 2:5]).any(axis=1) & ~new_block & place & (rows[:, out] == 0)
        if later.any():
            found, ref = rows[later].copy(), rows[first[later]]
            found[:, 5] = -(found[:, 5] % HOT - 1 + WINDOW)
            found[:, 1], found[:, 6], found[:, 7] = ref[:, 3], ref[:, 2], ref[:, 4]
            yield _batch(*found.T[:width])
        group = np.cumsum(new_key) - 1
        several = (np.bincount(group, weights=new_block)[group] > 1) | (rows[:, 5] > HOT)
        check = new_block & several & place & (rows[:, out] == 0)
        if check.any():
            yield _batch(*rows[check].T[:width])
        rows[check, out] = 1
        tail = np.flatnonzero(new_key)[-1]
        held = rows[np.unique([tail, first[-1]])].copy()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(low, SLICE_ROWS)


@lean
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames of their words, so that the joins move less."""
    press = zstandard.ZstdCompressor(level=1)
    for b in _sliced(batches):
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        tags = pa.array([text_tag(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc"), tags, pa.array([press.compress(t) for t in texts], pa.binary())], ["doc", "tag", "packed"])


@lean
def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of the blocks to check, as blocks of one window whose key and block are its two hashes."""
    unpack = zstandard.ZstdDecompressor()
    docs, tags, found, size = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, block, row, start = (np.concatenate(x) for x in zip(*found))
        yield from _resolved(key, block, np.array(docs, "<i8"), np.array(tags, "<i8"), row, start, np.ones(len(start), "<i8"))

    for b in _sliced(batches):
        for doc, tag, packed, checks in zip(*(b.column(c).to_pylist() for c in ("doc", "tag", "packed", "checks"))):
            one, two = window_hashes(word_hashes([unpack.decompress(packed)])[0])
            at = np.unique(np.concatenate([np.arange(c["start"], c["start"] + c["n"]) for c in checks]))
            found.append((one[at], two[at], np.full(len(at), len(docs)), at))
            docs.append(doc)
            tags.append(tag)
            size += len(at)
            if size > WINDOWS_AT_ONCE:
                yield from flush()
                docs, tags, found, size = [], [], [], 0
    if found:
        yield from flush()


def _sorted_by_place(rows: DataFrame) -> DataFrame:
    dealt = F.expr(f"if(n > {HOT}, xxhash64(key, block), key)")
    return rows.repartition(dealt).sortWithinPartitions("key", "block", "doc", "tag", "start")


def greedy(start: list[int], stop: list[int]) -> list[tuple[int, int, int]]:
    """The parse of one document by its matches, sorted by start: (match, from, to) of each factor."""
    out, at, i, best, n = [], 0, 0, -1, len(start)
    while True:
        while i < n and start[i] <= at:
            if best < 0 or stop[i] > stop[best]:
                best = i
            i += 1
        if best >= 0 and stop[best] > at:
            out.append((best, at, stop[best]))
            at = stop[best]
        elif i < n:
            at = start[i]
        else:
            return out


_FACTOR = "struct<start: long, length: long, ref_doc: long, ref_tag: long, ref_start: long>"


@lean
def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column("spans")
        flat = {f: x.to_numpy(zero_copy_only=False) for f, x in zip(("start", "n", "rtag", "rdoc", "rstart"), spans.flatten().flatten())}
        owner = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        refs, ref = np.unique(np.stack((flat["rdoc"], flat["rtag"]), axis=1), axis=0, return_inverse=True)
        i, begin, end, ref_start = chained(owner, ref.ravel(), flat["start"], flat["start"] - flat["n"], flat["rstart"])
        order = np.lexsort((begin, owner[i]))
        whose, refs, begin, end, ref_start = owner[i][order], refs[ref.ravel()[i][order]], begin[order], end[order], ref_start[order]
        cuts = np.searchsorted(whose, np.arange(len(spans) + 1))
        rows, sizes = [], []
        starts, stops = begin.tolist(), end.tolist()
        for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
            parse = greedy(starts[a:z], stops[a:z])
            sizes.append(len(parse))
            rows += [(a + k, low, high) for k, low, high in parse]
        k, low, high = np.array(rows, "<i8").reshape(-1, 3).T
        fields = [low, high - low, refs[k, 0], refs[k, 1], ref_start[k] + low - begin[k]]
        structs = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "ref_doc", "ref_tag", "ref_start"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), structs)
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), lists], ["doc", "tag", "factors"])


def parse(docs: DataFrame) -> DataFrame:
    """(doc, tag, factors) of each document (doc_id, or NULL_ID; text_tag() of the text) that has factors.

    A factor says that ``length`` words from word ``start`` on also stand from word ``ref_start`` of
    the reference document on, earlier. Words between factors are literals.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    # used twice below: the plan shares the exchange of the parsed blocks, so only the short index pass runs again
    found = _sorted_by_place(rows.mapInArrow(_parse, _ROW)).mapInArrow(_index, _ROW)
    checks = found.where("n > 0").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", F.expr(f"n % {HOT}").alias("n"))).alias("checks"))
    packed = rows.mapInArrow(_pack, "doc long, tag long, packed binary")
    windows = packed.join(checks, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).mapInArrow(_boundaries, _ROW)
    more = _sorted_by_place(windows).mapInArrow(_index, _ROW)
    matches = found.where("n < 0").unionByName(more.where("n < 0"))
    spans = matches.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", F.col("block").alias("rtag"), "rdoc", "rstart")).alias("spans"))
    return spans.mapInArrow(_factors, f"doc long, tag long, factors array<{_FACTOR}>")


@lean
def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in _sliced(batches):
        out: list[tuple] = []
        for packed, starts, sizes in zip(*(b.column(c).to_pylist() for c in ("packed", "starts", "sizes"))):
            parts = unpack.decompress(packed).split()
            kept = _kept(parts, starts, sizes)
            out.append((len(parts), len(parts) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _kept(parts: list[bytes], starts, sizes) -> list[bytes]:
    """The literals of a parse."""
    if starts is None or not len(starts):
        return parts
    out, at = [], 0
    for a, n in zip(starts, sizes):
        out += parts[at:a]
        at = a + n
    return out + parts[at:]


def kept_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(_pack, "doc long, tag long, packed binary").join(parse(docs), ["doc", "tag"], "left")
    shaped = packed.select(F.expr(f"nullif(doc, {NULL_ID + 1}L - 1L)").alias("doc_id"), "packed", F.col("factors.start").alias("starts"), F.col("factors.length").alias("sizes"))
    return shaped.mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _without(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series(
        [t if a is None or not len(a) else b" ".join(_kept((t or "").encode().split(), a.tolist(), n.tolist())).decode() for t, a, n in zip(texts, starts, sizes)], dtype=object
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated spans cut from text: the kept words joined by one space; texts without any stay as they are."""
    cols = docs.columns
    doc, tag, d, t, f = fresh_names(docs, "doc", "tag", "d", "t", "factors")
    found = parse(docs).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("factors").alias(f))
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), t: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    cut = keyed.join(found, (F.col(d) == F.col(doc)) & (F.col(t) == F.col(tag)), "left")
    without = F.pandas_udf(_without, "string")
    return cut.withColumn("text", without(F.col("text").cast("string"), F.col(f"{f}.start"), F.col(f"{f}.length"))).select(*cols)
