"""Line dedup: lines that many documents hold stay in one of them.

Keys of long lines are hashed to 128 bits, one row for each key of a document with the line's
places in it. The rows are range-partitioned by (hash, document from the largest) and sorted by
them, so a hot line's rows spread over as many tasks as its share asks for. Each task streams its
rows: a key's first row is its first occurrence in that order, the one that stays; once the key has
shown LEAST_DOCS documents, all rows of the others are dropped. Keys at a partition's ends may go on
in its neighbours: their rows wait, and a row for each end carries how many documents the
partition saw and the largest, which is added up over partitions (two rows each) and settles
those that wait. What comes back for a document is a compressed bitmap of the lines to keep,
never text: zlib over bits, least significant first, one for each line up to the last one
dropped and some more; lines beyond the map stay.

Edge cases: a null or empty text is one empty line; a line without break at the end of a text is
a line like any other, and only \\n parts lines; white space and letter case count as the key says
and only there, kept lines come out as they were. A document is what shares a doc_id: rows that
repeat an id count once, and all of them keep or lose a line. Rows without an id count as one
document, smaller than any other. Other columns pass through ``drop_lines`` untouched, whatever
their names.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from botledger.llm.common import fresh_names, lean, stage_out

#: Code points of a key from which it counts, and documents from which its lines go.
LEAST_CHARS, LEAST_DOCS = 40, 5
_SPACE = b" \t\n\x0b\x0c\r"
_ROW = "h1 long, h2 long, doc long, tag long, places array<int>"
_RUN = f"kind int, {_ROW}, n long"
#: Kinds of rows that a streaming task returns.
DROPPED, WAITING, END = 0, 1, 2
#: Keys at most in a batch of rows that goes back to Spark.
OUT_ROWS = 20_000


def keys(data: bytes) -> dict[bytes, list[int]]:
    """Places of each long key's lines in a text, by its hash."""
    out: dict[bytes, list[int]] = {}
    for at, line in enumerate(data.split(b"\n")):
        if len(line) >= LEAST_CHARS:
            key = line.strip(_SPACE).lower()  # of bytes: A-Z alone
            if len(key) >= LEAST_CHARS and (key.isascii() or len(key.decode("utf-8", "replace")) >= LEAST_CHARS):
                out.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
    return out


@lean
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, docs, tags, places = [], [], [], []
        seen = set()
        for doc, tag, text in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("text")):
            if (doc, tag) in seen:
                continue
            seen.add((doc, tag))
            for digest, at in keys(text.as_py()).items():
                hashes.append(digest)
                docs.append(doc)
                tags.append(tag)
                places.append(at)
            if len(hashes) >= OUT_ROWS:
                yield _rows(hashes, docs, tags, places)
                hashes, docs, tags, places = [], [], [], []
        if hashes:
            yield _rows(hashes, docs, tags, places)


def _rows(hashes: list[bytes], docs: list, tags: list[int], places: list[list[int]]) -> pa.RecordBatch:
    h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    cols = [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, ["h1", "h2", "doc", "tag", "places"])


class _Runs:
    """Streams sorted rows: the runs of one key each, over any number of batches, held only until LEAST_DOCS documents have shown.

    Documents are compared by (has an id, id); a run's first document is its largest.
    """

    def __init__(self) -> None:
        self.started = False
        self.mode = ""  # of the run that batches leave open: "waiting" (the partition's first), "dropping", or "" if its rows are held
        self.key = self.top = self.last = None
        self.n = 0
        self.held: pa.Table | None = None
        self.before: tuple | None = None

    @staticmethod
    def _columns(rows: pa.Table) -> list[np.ndarray]:
        doc = rows.column("doc").combine_chunks()
        return [
            rows.column("h1").to_numpy(), rows.column("h2").to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(zero_copy_only=False), rows.column("tag").to_numpy()
        ]

    def _distinct(self, rows: pa.Table) -> pa.Table:
        """Without rows that repeat the one before in key, document and text."""
        cols = self._columns(rows)
        new = np.zeros(len(rows), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = tuple(c[0] for c in cols) != self.before
        self.before = tuple(c[-1] for c in cols)
        return rows if new.all() else rows.filter(pa.array(new))

    def feed(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = self._distinct(rows) if len(rows) else rows
        if not len(rows):
            return
        if not self.started:
            self.started, self.mode, self.n, self.last = True, "waiting", 0, None
            h1, h2, valid, doc, _ = self._columns(rows)
            self.key, self.top = (h1[0], h2[0]), (valid[0], doc[0])
        if self.mode:
            rows = yield from self._go_on(rows)
        if len(rows):
            yield from self._complete(rows)

    def _go_on(self, rows: pa.Table):
        """Rows of the run that was open; returns the others."""
        h1, h2, valid, doc, _ = self._columns(rows)
        same = (h1 == self.key[0]) & (h2 == self.key[1])
        k = len(rows) if same.all() else int(np.argmin(same))
        if k:
            change = np.ones(k, bool)
            change[1:] = (valid[1:k] != valid[: k - 1]) | (doc[1:k] != doc[: k - 1])
            change[0] = self.last != (valid[0], doc[0])
            self.n += int(change.sum())
            self.last = (valid[k - 1], doc[k - 1])
            part = rows.slice(0, k)
            if self.mode == "dropping":
                part = part.filter(pa.array((valid[:k] != self.top[0]) | (doc[:k] != self.top[1])))
            if len(part):
                yield _told(part, WAITING if self.mode == "waiting" else DROPPED)
        if k < len(rows):
            if self.mode == "waiting":
                yield self._end()
            self.mode = ""
        return rows.slice(k)

    def _complete(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Runs that begin in this partition: all but the last one are whole."""
        rows = pa.concat_tables([self.held, rows]).combine_chunks() if self.held is not None else rows
        self.held = None
        h1, h2, valid, doc, _ = self._columns(rows)
        first = np.ones(len(rows), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new = first.copy()
        new[1:] |= (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        docs = np.add.reduceat(new.astype(np.int64), starts)
        away = (valid != valid[starts][run]) | (doc != doc[starts][run])
        go = away & (docs[run] >= LEAST_DOCS)
        if go.any():
            yield _told(rows.filter(pa.array(go)), DROPPED)
        at = starts[-1]
        self.key, self.n, self.top, self.last = (h1[at], h2[at]), int(docs[-1]), (valid[at], doc[at]), (valid[-1], doc[-1])
        if docs[-1] >= LEAST_DOCS:
            self.mode = "dropping"
        else:
            self.held = rows.slice(at)

    def _end(self) -> pa.RecordBatch:
        doc = int(self.top[1]) if self.top[0] else None
        row = {"kind": END, "h1": int(self.key[0]), "h2": int(self.key[1]), "doc": doc, "tag": 0, "places": None, "n": self.n}
        return pa.RecordBatch.from_pylist([row], schema=_RUN_ARROW)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.started:
            if self.held is not None:
                yield _told(self.held, WAITING)
            yield self._end()


_RUN_ARROW = pa.schema(
    [("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("places", pa.list_(pa.int32())), ("n", pa.int64())]
)


def _told(rows: pa.Table, kind: int) -> pa.RecordBatch:
    n = len(rows)
    cols = [pa.array(np.full(n, kind, np.int32)), *[rows.column(c).combine_chunks() for c in ("h1", "h2", "doc", "tag", "places")], pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _RUN_ARROW)], schema=_RUN_ARROW)


@lean
def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _Runs()
    for b in batches:
        yield from runs.feed(pa.Table.from_batches([b]))
    yield from runs.finish()


@lean
def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, maps = [], []
        for places in b.column("places"):
            at = np.unique(np.asarray(places.values))
            bits = np.ones((int(at[-1]) // 8 + 1) * 8, np.uint8)
            bits[at] = 0
            sizes.append(len(at))
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["doc", "tag", "n_dropped", "keep"])


def _tag() -> Column:
    """Tells apart texts that share an id."""
    return F.xxhash64(F.col("text").cast("string"), F.octet_length(F.col("text").cast("string")))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc, tag, n_dropped, keep) for each document that loses lines: its id, a hash of its text, and the bitmap of the lines that stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), _tag().alias("tag"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last()]
    placed = rows.mapInArrow(_keyed, _ROW).repartitionByRange(*order).sortWithinPartitions(*order, "tag")
    runs = stage_out(placed.mapInArrow(_stream, _RUN), "line-runs")
    ends = runs.where(F.col("kind") == END).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= LEAST_DOCS)
    waiting = runs.where(F.col("kind") == WAITING).select("h1", "h2", "doc", "tag", "places")
    # two ends of each partition at most, whatever the rows
    settled = waiting.join(F.broadcast(ends), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("top"))).select("doc", "tag", "places")
    gone = runs.where(F.col("kind") == DROPPED).select("doc", "tag", "places").unionByName(settled)
    by_doc = gone.groupBy("doc", "tag").agg(F.flatten(F.collect_list("places")).alias("places"))  # a document's own lines
    return by_doc.mapInArrow(_bitmaps, "doc long, tag long, n_dropped long, keep binary")


def kept_lines(text: str, keep: bytes) -> str:
    """The text without the lines that a bitmap drops."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    lines = text.split("\n")
    stays = np.ones(len(lines), np.uint8)
    n = min(len(lines), len(bits))
    stays[:n] = bits[:n]
    return "\n".join(itertools.compress(lines, stays.tolist()))


def drop_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs with the lines to drop cut from their texts (null texts stay null if nothing goes), plus n_lines and n_dropped if asked for."""
    tag, doc, dropped, keep = fresh_names(docs, "tag", "doc", "n_dropped", "keep")
    maps = keep_bitmaps(docs).select(F.col("doc").alias(doc), F.col("tag").alias(tag + "m"), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep))
    own = docs.withColumn(tag, _tag())
    joined = own.join(maps, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(tag) == F.col(tag + "m")), "left")

    @arrow_udf("string")
    def cut(text: pa.Array, bits: pa.Array) -> pa.Array:
        return pa.array([None if k is None else kept_lines(t, k) for t, k in zip(text.to_pylist(), bits.to_pylist())], pa.string())

    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(cut(F.when(F.col(keep).isNotNull(), F.col("text").cast("string")), F.col(keep)))
    rest = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text}
    whole = F.coalesce(F.col("text"), F.lit(""))
    lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    more = [lines.cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return joined.select(*[c.alias(n) for n, c in rest.items()], *more)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    out = drop_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
