"""Log files as rows: a Python data source that reads bytes the way the log grammars need them.

``spark.read.text`` won't do: it takes compression from the file name, drops a leading BOM,
fails on padding after gzip data and has no mark for a damaged file. Here gzip is known by its
first two bytes and read over all members; a damaged file yields its complete lines and a
``truncated`` mark on its status row; invalid UTF-8 becomes U+FFFD; lines end at CRLF, CR or LF.

A file's first non-blank line shows its format, and a file of unknown format is an error where files are parsed. With
``lenient`` the first line that fits a grammar shows it, so that a broken line at its head costs a file no more than
that line; one without any such line has malformed lines only.

Rows: file, line_no (from 1; null on the status row that ends each file), line, truncated, fmt,
spots. The reader sees a file's first line, so it says the format of each line (``fmt``, null if
the line fits none; the status row of such a file holds its first line), and it sees CloudFront's
headers in order, so it says where the needed columns are (``spots``): nothing has to be
joined or windowed to parse the rows, in batch or as a stream.

Long files are split when ``split`` is true: plain ones at line starts, CloudFront's with the header
that holds where a range begins, gzip files at their members (see splits); line numbers then count
from the plain byte offset upward (ordered, not dense). Files that end lines at CR alone, gzip
files of one member and gzipped CloudFront files stay whole. ``head`` reads each
file's first non-blank line alone. Small files share tasks by size; planning reads listings, not
files. As a stream (``spark.readStream``) the source reads each file once, whatever order and times
files come in (see arrivals); files must come in whole (moved, not grown).

Files are opened where tasks run, so plain paths must be ones that every executor sees. Addresses
with a scheme go through pyarrow's file systems where these know it (ranges and any size), else
through Spark's binary file source, a file (up to 2 GB, Spark's limit of a value) to a row.
"""

from __future__ import annotations

import functools
import gzip
import io
import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from botledger.operators import lines as grammar
from botledger.sources import splits, stores
from botledger.sources.arrivals import Ledger
from botledger.sources.splits import Piece

SCHEMA = "file string, line_no bigint, line string, truncated boolean, fmt string, spots array<int>"
_ARROW = pa.schema(
    [("file", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("truncated", pa.bool_()), ("fmt", pa.string()), ("spots", pa.list_(pa.int32()))]
)
BATCH_LINES = 20_000
#: Ranges are as long as gives every core a few, within these bounds.
LEAST_RANGE, MOST_RANGE = 4 << 20, 128 << 20
#: Bytes that opening a file counts as where small files share a task.
OPEN_COST = 1 << 18
#: Files of a stream's batch, unless told otherwise.
MOST_FILES = 10_000


class UnknownFormatError(ValueError):
    """A file's first line fits no grammar."""


def lines_of(raw: io.BufferedIOBase, damaged: list[bool]) -> Iterator[str]:
    """Complete lines of a byte stream; damaged gets an entry if compressed data breaks off."""
    head = raw.peek(2)[:2] if hasattr(raw, "peek") else b""
    stream = gzip.GzipFile(fileobj=raw) if head == b"\x1f\x8b" else raw
    text = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None)
    held: str | None = None
    try:
        for line in text:
            if held is not None:
                yield held
            held = line
        if held is not None:
            yield held
    except (EOFError, OSError, zlib.error):
        damaged.append(True)
        if held is not None and held.endswith("\n"):
            yield held


class _Sheet:
    """Rows of one file on their way to Arrow: says the format once a line shows it, and keeps the spots of the last good header."""

    def __init__(self, file: str, fmt: str | None, first: str | None = None):
        self.file, self.fmt, self.first, self.forced = file, fmt, first, fmt is not None
        self.spots: list[int] | None = None
        self.lines: list[str] = []
        self.runs: list[tuple[int, list[int] | None]] = []  # (rows from here on, spots)

    def add(self, line: str) -> None:
        if self.first is None and line and not line.isspace():
            self.first = line
            self.fmt = self.fmt if self.forced else grammar.format_of(line)
        if self.fmt == "cloudfront" and line.startswith("#Fields:") and (spots := grammar.header_spots(line)):
            self.spots = spots
            self.runs.append((len(self.lines), spots))
        self.lines.append(line)

    def batch(self, numbers: np.ndarray) -> pa.RecordBatch:
        n = len(self.lines)
        if self.fmt == "cloudfront" and (self.runs or self.spots):
            before = self.runs[0][0] if self.runs else n
            cuts = [before] + [z - a for (a, _), z in zip(self.runs, [r[0] for r in self.runs[1:]] + [n])]
            values = [self._old] + [s for _, s in self.runs]
            parts = [np.tile(np.array(v, "<i4"), k) for k, v in zip(cuts, values) if v]
            sizes = np.repeat([len(v or ()) for v in values], cuts)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<i4")
            spots = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, "<i4")), mask=pa.array(sizes == 0))
        else:
            spots = pa.nulls(n, pa.list_(pa.int32()))
        out = pa.RecordBatch.from_arrays(
            [pa.repeat(self.file, n), pa.array(numbers, pa.int64()), pa.array(self.lines, pa.string()), pa.nulls(n, pa.bool_()), _same(self.fmt, n), spots], schema=_ARROW
        )
        self.lines, self.runs = [], []
        self._old = self.spots
        return out

    _old: list[int] | None = None

    def start_at(self, spots: list[int] | None) -> None:
        """Columns that hold until a header says otherwise."""
        self.spots = self._old = spots

    def fill(self, data: bytes) -> bool:
        """Take the lines of a block of bytes; whether there are any."""
        text = data.decode("utf-8", "replace")
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.lines = text.split("\n")
        if not self.lines[-1]:
            self.lines.pop()
        if self.fmt == "cloudfront" and "#Fields:" in text:
            for k, line in enumerate(self.lines):
                if line.startswith("#Fields:") and (spots := grammar.header_spots(line)):
                    self.spots = spots
                    self.runs.append((k, spots))
        return bool(self.lines)

    def status(self, damaged: bool) -> pa.RecordBatch:
        unknown = self.first if self.fmt is None else None
        return pa.RecordBatch.from_pylist([{"file": self.file, "line": unknown, "truncated": damaged, "fmt": self.fmt}], schema=_ARROW)


def _same(value: str | None, n: int) -> pa.Array:
    return pa.nulls(n, pa.string()) if value is None else pa.repeat(value, n)


def _whole(file: str, raw: io.BufferedIOBase, fmt: str | None, head: bool, first: str | None = None) -> Iterator[pa.RecordBatch]:
    """All rows of a file from its first byte on, or the row of its first line; ``first`` is that line if the file has been looked at for its format."""
    damaged: list[bool] = []
    sheet, at = _Sheet(file, fmt, first), 1
    source = lines_of(raw, damaged)
    if head:
        for k, line in enumerate(source, 1):
            if line and not line.isspace():
                sheet.add(line.rstrip("\n"))
                yield sheet.batch(np.array([k]))
                return
        return
    for line in source:
        sheet.add(line.rstrip("\n"))
        if len(sheet.lines) >= BATCH_LINES:
            n = len(sheet.lines)
            yield sheet.batch(np.arange(at, at + n))
            at += n
    if sheet.lines:
        yield sheet.batch(np.arange(at, at + len(sheet.lines)))
    yield sheet.status(bool(damaged))


def _rows(piece: Piece, opened: Callable[[], io.BufferedReader], fmt: str | None, head: bool, lenient: bool) -> Iterator[pa.RecordBatch]:
    first = None
    if piece.kind != "whole" or (lenient and not fmt):
        with opened() as f:
            first, own = splits.shown(lines_of(f, []), lenient and not fmt)
        fmt = fmt or own
    with opened() as f:
        yield from _whole(piece.path, f, fmt, head, first) if piece.kind == "whole" else _part(piece, f, fmt, first)


def _part(piece: Piece, f: io.BufferedReader, fmt: str | None, first: str | None) -> Iterator[pa.RecordBatch]:
    sheet = _Sheet(piece.path, fmt, first)
    if piece.kind == "lines":
        yield from _range(sheet, piece, f)
    else:
        yield from _from_members(sheet, piece, f)


def _range(sheet: _Sheet, piece: Piece, f: io.BufferedReader) -> Iterator[pa.RecordBatch]:
    """Lines that start in the range, numbered by byte offset; a range's first line may have begun before it."""
    sheet.start_at(piece.spots)
    for at, data in splits.blocks(f, piece.start, piece.stop):
        if sheet.fill(data):
            yield sheet.batch(at + 1 + np.arange(len(sheet.lines)))
    if piece.start == 0:
        yield sheet.status(False)


def _from_members(sheet: _Sheet, piece: Piece, f: io.BufferedReader) -> Iterator[pa.RecordBatch]:
    """Lines that start in the piece's members, numbered by the plain text's bytes before them."""
    damaged: list[bool] = []
    at = piece.number
    for data in splits.lines_of_members(f, piece, damaged):
        if sheet.fill(data):
            yield sheet.batch(at + 1 + np.arange(len(sheet.lines)))
        at += len(data)
    if piece.last:
        yield sheet.status(bool(damaged))


class _Part(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def packed(pieces: Iterable[tuple[Piece, int]], most: int, count: int | None = None) -> list[list[Piece]]:
    """Pieces in order, in tasks of so many bytes (and pieces); opening a file counts as OPEN_COST of them. Parts of a file that meet in a task are read as one."""
    out: list[list[Piece]] = []
    left = 0
    for piece, size in pieces:
        joined = splits.joined(out[-1][-1], piece) if out else None
        cost = size if joined else size + OPEN_COST
        if not out or cost > left or (count and len(out[-1]) >= count):
            out.append([piece])
            left = most - size
        elif joined:
            out[-1][-1] = joined
            left -= cost
        else:
            out[-1].append(piece)
            left -= cost
    return out


class _Reader(DataSourceReader):
    """Reads what a plan in the options says; bare ``paths`` are listed and read whole."""

    def __init__(self, options: dict):
        self.head = str(options.get("head", "false")).lower() == "true"
        self.fmt, self.lenient = options.get("fmt") or None, str(options.get("lenient", "false")).lower() == "true"
        self.plan = json.loads(options["plan"]) if options.get("plan") else None
        self.paths = [p for p in options.get("paths", "").split("\n") if p]

    def __getstate__(self) -> dict:
        """What each task gets: not the plan, which grows with the files; a task's own part comes with it."""
        return self.__dict__ | {"plan": None, "paths": []}

    def partitions(self) -> list[InputPartition]:
        if self.plan is None:
            found = [f for p in self.paths for f in stores.listing(p)]
            return [_Part(p) for p in packed(((Piece(f.path), f.size) for f in found), MOST_RANGE)] or [_Part([])]
        return [_Part([Piece(*x) for x in part]) for part in self.plan] or [_Part([])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        for piece in part.pieces:
            yield from _rows(piece, functools.partial(stores.open_file, piece.path), self.fmt, self.head, self.lenient)


class _Stream(DataSourceStreamReader):
    """Files of a folder, each once: an offset is the number of a ledger's entry."""

    def __init__(self, options: dict):
        self.specs, self.fmt = [p for p in options["paths"].split("\n") if p], options.get("fmt") or None
        self.lenient = str(options.get("lenient", "false")).lower() == "true"
        self.tasks = int(options.get("tasks", 1))
        self.ledger, self.most = options["ledger"], int(options.get("maxFilesPerTrigger", options.get("maxfilespertrigger", MOST_FILES)))
        self._open: Ledger | None = None

    def _ledger(self) -> Ledger:
        """Opened where offsets are planned; tasks don't need it."""
        if self._open is None:
            self._open = Ledger(self.ledger, self.specs, self.most)
        return self._open

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        return {"entry": self._ledger().look()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = self._ledger().between(start["entry"], end["entry"])
        # packed files have more lines than their sizes say, so files are dealt by number, too
        return [_Part(p) for p in packed(((Piece(f.path), f.size) for f in found), MOST_RANGE, -(-len(found) // self.tasks))] or [_Part([])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        for piece in part.pieces:
            yield from _rows(piece, functools.partial(stores.open_file, piece.path), self.fmt, False, self.lenient)

    def commit(self, end: dict) -> None:
        self._ledger().done(end["entry"])


class AccessLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "accesslog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _from_store(head: bool, fmt: str | None, lenient: bool):
    """The source's rows from whole files as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                data = content.as_py()
                yield from _rows(Piece(path), lambda data=data: io.BufferedReader(io.BytesIO(data)), fmt, head, lenient)

    return run


def plan(spark: SparkSession, specs: list[str], fmt: str | None, split: bool, head: bool, split_bytes: int | None, lenient: bool = False) -> list[list[Piece]]:
    """What each task reads: the listing gives names and sizes, small files share tasks, long ones are split; but for a few long ones, no file is opened here.

    Ranges may be as short as ``split_bytes``; a task takes as many as leave each core a few tasks, so that their number doesn't grow with the input
    until they are MOST_RANGE long.
    """
    found = [f for s in specs for f in stores.listing(s)]
    total = sum((0 if head else f.size) + OPEN_COST for f in found)
    most = split_bytes or max(LEAST_RANGE, min(MOST_RANGE, total // (2 * spark.sparkContext.defaultParallelism) + 1))
    if head:
        return packed(((Piece(f.path), 0) for f in found), most)
    how = splits.ways(spark, [f.path for f in found if f.size > most], fmt, lenient) if split else {}
    task = max(most, min(MOST_RANGE, sum(f.size for f in found) // (4 * spark.sparkContext.defaultParallelism)))
    return packed(splits.pieces(spark, found, most, how), task)


def read_lines(spark: SparkSession, paths: str | list[str], fmt: str | None = None, **options: object) -> DataFrame:
    """The source's rows for one path or several (files, folders, patterns; local or in any store Spark reads)."""
    if fmt is not None and fmt not in grammar.FORMATS:
        raise ValueError(f"format must be one of {', '.join(grammar.FORMATS)}")
    specs = [paths] if isinstance(paths, str) else list(paths)
    flag = lambda name: str(options.get(name, "false")).lower() == "true"
    if not all(map(stores.known, specs)):
        return spark.read.format("binaryFile").load(specs).select("path", "content").mapInArrow(_from_store(flag("head"), fmt, flag("lenient")), SCHEMA)
    split_bytes = options.get("splitBytes", options.get("splitbytes"))
    parts = plan(spark, specs, fmt, flag("split"), flag("head"), int(split_bytes) if split_bytes else None, flag("lenient"))
    spark.dataSource.register(AccessLogSource)
    reader = spark.read.format("accesslog").option("plan", json.dumps(parts)).option("fmt", fmt or "").option("head", str(flag("head"))).option("lenient", str(flag("lenient")))
    return reader.load()


def stream_lines(spark: SparkSession, folder: str, ledger: str, fmt: str | None = None, max_files: int = MOST_FILES, lenient: bool = False) -> DataFrame:
    """The source's rows of the files that come into a folder (or match a pattern), as a stream: each file once, at most max_files a batch (0: all).

    ``ledger`` is the folder of the query's list of files seen (see arrivals), best beside its checkpoint. For stores that only Spark
    opens, Spark's own file source keeps that list in the checkpoint; a path counts once there, whatever becomes of its file.
    """
    if not stores.known(folder):
        raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFileAge", "36500d")
        rows = (raw.option("maxFilesPerTrigger", max_files) if max_files else raw).load(folder)
        return rows.select("path", "content").mapInArrow(_from_store(False, fmt, lenient), SCHEMA)
    spark.dataSource.register(AccessLogSource)
    reader = spark.readStream.format("accesslog").option("paths", folder).option("fmt", fmt or "").option("ledger", ledger).option("lenient", str(lenient)).option("tasks", str(4 * spark.sparkContext.defaultParallelism))
    return reader.option("maxFilesPerTrigger", str(max_files)).load()


def lines_from_text(spark: SparkSession, text: str, file: str = "pasted") -> DataFrame:
    """Rows of a pasted log."""
    return lines_of_texts(spark.createDataFrame([(file, text)], "file string, text string"))


def lines_of_texts(texts: DataFrame, lenient: bool = False) -> DataFrame:
    """(file, line_no, line) of texts(file, text), whatever ends their lines; a break at the end starts no line.

    If lenient, also ``fmt``: what a text's first line shows that fits a grammar; lines after that one are not looked at.
    """
    rows = texts.select("file", F.split("text", "\r\n|\r|\n", -1).alias("lines"))
    last = F.when(F.element_at("lines", -1) == "", F.size("lines") - 1).otherwise(F.size("lines"))
    kept = ["file"]
    if lenient:
        rows = rows.withColumn("fmt", F.aggregate("lines", F.lit(None).cast("string"), lambda found, line: F.coalesce(found, grammar.line_format(line))))
        kept.append("fmt")
    flat = rows.select(*kept, F.posexplode(F.slice("lines", F.lit(1), last)).alias("at", "line"))
    return flat.select("file", (F.col("at") + 1).cast("long").alias("line_no"), "line", *kept[1:])


def check_formats(unknown: DataFrame) -> None:
    """An error that names the first of unknown(file, first), if there is any row."""
    row = unknown.select("file", F.left("first", F.lit(300)).alias("first")).orderBy("file").first()
    if row is not None:
        raise UnknownFormatError(f"{row['file']}: no known log format; its first line is: {row['first']}")


def with_format(lines: DataFrame, fmt: str | None = None, lenient: bool = False) -> DataFrame:
    """lines(file, line_no, line) plus ``fmt``: forced, or found per file and joined back.

    A file of unknown format is an error that names its first line; if lenient, the first line that fits a grammar shows a file's format (null if none does).
    """
    if fmt is not None:
        if fmt not in grammar.FORMATS:
            raise ValueError(f"format must be one of {', '.join(grammar.FORMATS)}")
        return lines.withColumn("fmt", F.lit(fmt))
    if lenient:
        return lines.join(grammar.first_fit_by_file(lines), "file", "left")
    per_file = grammar.detect_by_file(lines)
    check_formats(per_file.where("fmt is null"))
    return lines.join(per_file.select("file", "fmt"), "file", "left")
