"""How long files split: by lines, by lines with a carried header (CloudFront), by gzip members, or not at all.

CloudFront: a job looks for the last good ``#Fields:`` header of each range, and a running last over
a file's ranges gives each the columns that it starts with. Gzip: a job looks for member headers,
inflates from each to the trailer whose check sum and length must hold, and so has the members'
true ends; what tiles the file from its first byte on is cut into pieces at member starts, and what
follows the first gap (padding, damage, members with odd headers) is the last piece, read in order
like a whole file. A line belongs to the piece that it starts in; pieces know whether they begin
within a line, and read on past their end to finish their last one.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.operators import lines as grammar
from botledger.sources import stores

#: Bytes of a range read at once, and those of a file looked at to plan its ranges.
CHUNK, HEAD = 1 << 20, 1 << 16
#: Plain bytes of a gzip member at once.
PLAIN = 1 << 16
#: Long files that the driver itself looks at to plan; more are looked at by a job.
FEW_FILES = 16
_MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]", re.S)


class Piece(NamedTuple):
    """A file, or a part of it.

    kind ``whole``; ``lines``: from byte start to stop, with the columns (spots) that CloudFront's first lines have;
    ``members``: gzip members from start to stop; ``rest``: from start to the end of a gzip file. Of the last two, ``joined``
    says that they begin within a line, ``number`` is the plain text's bytes before them, ``last`` that none follows.
    """

    path: str
    kind: str = "whole"
    start: int = 0
    stop: int = 0
    spots: list[int] | None = None
    joined: bool = False
    number: int = 0
    last: bool = True


def joined(a: Piece, b: Piece) -> Piece | None:
    """Both parts as one, if they are of one kind and the second begins where the first ends."""
    return a._replace(stop=b.stop, last=b.last) if a.kind == b.kind in ("lines", "members") and (a.path, a.stop) == (b.path, b.start) else None


def shown(lines: Iterator[str], lenient: bool = False) -> tuple[str | None, str | None]:
    """The first non-blank line and the format that it shows or, if lenient, that the first line shows that fits a grammar."""
    first = None
    for line in lines:
        if line and not line.isspace():
            line = line.rstrip("\n")
            first = line if first is None else first
            if (fmt := grammar.format_of(line)) or not lenient:
                return first, fmt
    return first, None


def how_to_split(path: str, fmt: str | None, lenient: bool = False) -> str:
    """``lines``, ``cloudfront``, ``gzip`` or ``whole``, from a file's first bytes."""
    with stores.open_file(path) as f:
        head = f.read(HEAD)
    packed = head[:2] == b"\x1f\x8b"
    if packed:
        try:
            head = zlib.decompressobj(31).decompress(head, HEAD)
        except zlib.error:
            return "whole"
    if b"\r" in head and b"\n" not in head:
        return "whole"
    fmt = fmt or shown(io.StringIO(head.decode("utf-8", "replace"), newline=None), lenient)[1]
    if fmt == "cloudfront":
        return "whole" if packed else "cloudfront"
    return "whole" if fmt is None else "gzip" if packed else "lines"


def ways(spark: SparkSession, long: list[str], fmt: str | None, lenient: bool = False) -> dict[str, str]:
    """how_to_split() of long files: a few are looked at here, more by a job."""
    if len(long) <= FEW_FILES:
        return {p: how_to_split(p, fmt, lenient) for p in long}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path")
            yield pa.RecordBatch.from_arrays([paths, pa.array([how_to_split(p, fmt, lenient) for p in paths.to_pylist()], pa.string())], ["path", "way"])

    tasks = min(len(long), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in long], "path string").repartition(tasks, "path")
    return {r["path"]: r["way"] for r in rows.mapInArrow(look, "path string, way string").collect()}  # a row for each long file, as the plan has several


def pieces(spark: SparkSession, found: list[stores.Found], most: int, how: dict[str, str]) -> Iterator[tuple[Piece, int]]:
    """Pieces with their sizes: files, or parts of those that ``how`` lets split."""
    marked = {way: [f for f in found if how.get(f.path) == way] for way in ("cloudfront", "gzip")}
    spots = _carried(spark, marked["cloudfront"], most) if marked["cloudfront"] else {}
    members = _members(spark, marked["gzip"], most) if marked["gzip"] else {}
    for f in found:
        way = how.get(f.path)
        if way in ("lines", "cloudfront"):
            for a in range(0, f.size, most):
                yield Piece(f.path, "lines", a, min(f.size, a + most), spots.get((f.path, a))), min(most, f.size - a)
        elif members.get(f.path):
            for p in members[f.path]:
                yield p, (p.stop or f.size) - p.start
        else:
            yield Piece(f.path), f.size


def _ranges(spark: SparkSession, found: list[stores.Found], most: int) -> DataFrame:
    """A row (path, start, stop) for each range, in as many tasks or, of very many, a few for each core."""
    rows = [(f.path, a, min(f.size, a + most)) for f in found for a in range(0, f.size, most)]
    return spark.createDataFrame(rows, "path string, start long, stop long").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism), "path", "start")


def blocks(f: io.BufferedReader, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of whole lines: those that start within the range; offsets count from the file's first byte."""
    f.seek(max(0, start - 1))
    at = start
    if start:
        at = start - 1 + len(f.readline())  # the rest of a line that an earlier range has, or the break before this one
    while at < stop:
        data = f.read(min(CHUNK, stop - at))
        data += f.readline() if not data.endswith(b"\n") else b""
        if not data:
            return
        yield at, data
        at += len(data)


_HEADER = re.compile(rb"(?:^|[\r\n])(#Fields:[^\r\n]*)")


def _carried(spark: SparkSession, found: list[stores.Found], most: int) -> dict[tuple[str, int], list[int]]:
    """Where columns stand when a range begins: the last good header of the ranges before it in its file."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, stop in zip(*[b.column(c).to_pylist() for c in ("path", "start", "stop")]):
                spots = None
                with stores.open_file(path) as f:
                    for _, data in blocks(f, start, stop):
                        good = (grammar.header_spots(h.decode("utf-8", "replace")) for h in reversed(_HEADER.findall(data)))
                        spots = next(filter(None, good), spots)
                yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "spots": spots}], schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("spots", pa.list_(pa.int32()))]))

    rows = _ranges(spark, found, most).mapInArrow(look, "path string, start long, spots array<int>")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    told = rows.select("path", "start", F.last("spots", ignorenulls=True).over(before).alias("spots")).where("spots is not null")
    return {(r["path"], r["start"]): list(r["spots"]) for r in told.collect()}  # a row for a range at most, as the plan has


def inflated(f: io.BufferedReader, start: int) -> Iterator[tuple[bytes, int | None]]:
    """(plain bytes, end) of a gzip member that starts there, a chunk at a time; ``end`` comes with the last one. A broken member is a zlib.error or EOFError."""
    f.seek(start)
    z, at, left = zlib.decompressobj(31), start, b""
    while not z.eof:
        data = left or f.read(CHUNK)
        at += 0 if left else len(data)
        plain = z.decompress(data, PLAIN)
        left = z.unconsumed_tail
        if not data and not plain and not z.eof:
            raise EOFError("a gzip member that breaks off")
        yield plain, (at - len(z.unused_data)) if z.eof else None


def _member(f: io.BufferedReader, start: int) -> dict | None:
    """A member's end, plain size, and whether it ends a line, if one starts there and its trailer holds."""
    size, tail = 0, b""
    try:
        for plain, end in inflated(f, start):
            size += len(plain)
            tail = plain[-1:] or tail
    except (zlib.error, EOFError):
        return None
    return {"start": start, "stop": end, "size": size, "ends": tail == b"\n" if size else None}


def _members(spark: SparkSession, found: list[stores.Found], most: int) -> dict[str, list[Piece]]:
    """Pieces of gzip files that have several members; a file of one is not here."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("size", pa.int64()), ("ends", pa.bool_())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, stop in zip(*[b.column(c).to_pylist() for c in ("path", "start", "stop")]):
                with stores.open_file(path) as f:
                    for a in range(start, stop, CHUNK):
                        f.seek(a)
                        data = f.read(min(CHUNK, stop - a) + 3)
                        at = [a + m.start() for m in _MEMBER.finditer(data) if m.start() < min(CHUNK, stop - a)]
                        if at:
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at, pa.int64())], ["path", "start"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with stores.open_file(path) as f:
                    m = _member(f, start)
                if m:
                    yield pa.RecordBatch.from_pylist([m | {"path": path}], schema=schema)

    seen = _ranges(spark, found, most).mapInArrow(places, "path string, start long")
    several = W.partitionBy("path")
    seen = seen.withColumn("n", F.count(F.lit(1)).over(several)).where("n > 1").select("path", "start")  # one member is not worth inflating twice
    true = seen.repartition("path", "start").mapInArrow(check, "path string, start long, stop long, size long, ends boolean")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    # what starts within another member is that one's data; the first gap ends the tiling
    tiled = true.withColumn("covered", F.coalesce(F.max("stop").over(before), F.lit(0).cast("long"))).where("start >= covered")
    tiled = tiled.withColumn("gap", F.max((F.col("start") > F.col("covered")).cast("int")).over(before.rowsBetween(W.unboundedPreceding, 0))).where("gap = 0")
    # of an empty member the one before says whether a line has ended
    tiled = tiled.withColumns({"number": F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")), "ended": F.coalesce(F.last("ends", ignorenulls=True).over(before), F.lit(True)), "last_ends": F.last("ends", ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, 0))})
    part = tiled.groupBy("path", F.floor(F.col("start") / most).alias("nth")).agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("number").alias("number"), F.min_by("ended", "start").alias("ended"),
        F.max_by("last_ends", "start").alias("last_ends"), F.max(F.col("number") + F.col("size")).alias("after"),
    )
    out: dict[str, list[Piece]] = {}
    sizes = {f.path: f.size for f in found}
    for r in part.orderBy("path", "start").collect():  # a row for a range at most, as the plan has
        out.setdefault(r["path"], []).append((r, Piece(r["path"], "members", r["start"], r["stop"], None, not r["ended"], r["number"], False)))
    done = {}
    for path, own in out.items():
        (end, _), ps = own[-1], [p for _, p in own]
        if ps[0].start == 0:
            rest = Piece(path, "rest", end["stop"], 0, None, end["last_ends"] is False, end["after"])
            done[path] = [*ps, rest] if end["stop"] < sizes[path] else [*ps[:-1], ps[-1]._replace(last=True)]
    return done


def _in_order(f: io.BufferedReader, at: int) -> Iterator[bytes]:
    """Plain bytes from a member's start to the file's end, zeros before and between members passed over; all that comes before damage."""
    start = _past_padding(f, at)
    if start is not None:
        f.seek(start)
        stream = gzip.GzipFile(fileobj=f)
        while plain := stream.read1(1 << 13):
            yield plain


def _in_members(f: io.BufferedReader, start: int, stop: int) -> Iterator[bytes]:
    while start < stop:
        for plain, end in inflated(f, start):
            yield plain
        start = end


def lines_of_members(f: io.BufferedReader, piece: Piece, damaged: list[bool]) -> Iterator[bytes]:
    """Whole lines of a ``members`` or ``rest`` piece as blocks of bytes; an unfinished line at a damaged place is left out, and marked if the piece has it."""
    held, skip, rest = b"", piece.joined, piece.kind == "rest"
    try:
        for plain in _in_order(f, piece.start) if rest else _in_members(f, piece.start, piece.stop):
            if skip:
                cut = plain.find(b"\n") + 1
                if not cut:
                    continue
                plain, skip = plain[cut:], False
            cut = plain.rfind(b"\n") + 1
            if cut:
                yield held + plain[:cut]
                held = plain[cut:]
            else:
                held += plain
        if held and not rest:  # the line goes on in what follows
            for plain in _in_order(f, piece.stop):
                cut = plain.find(b"\n") + 1
                held += plain[: cut or len(plain)]
                if cut:
                    break
    except (EOFError, OSError, zlib.error):
        if rest:
            damaged.append(True)
        held = b""
    if held:
        yield held


def _past_padding(f: io.BufferedReader, at: int) -> int | None:
    """The next byte that isn't zero, or null if none follows."""
    f.seek(at)
    while data := f.read(CHUNK):
        rest = data.lstrip(b"\0")
        if rest:
            return at + len(data) - len(rest)
        at += len(data)
    return None
