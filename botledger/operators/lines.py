"""From log lines to records: format detection and the three line grammars, as projections.

Input: file, line_no, line and, unless one format is forced, fmt (see line_format). Output: these,
outcome (``record``, ``malformed``, ``ignored`` or ``blank``) and, for records, ts (TIMESTAMP_NTZ in
UTC), path, status, ua, referrer. Lines of all formats are parsed in one projection, each by its
own grammar. Quoted fields use possessive groups: a hostile line costs linear time and no stack.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.functions import text as t
from botledger.functions import urls as u
from botledger.plans.settle import settle

FORMATS = ("combined", "cloudfront", "alb")

# Whole runs are taken possessively: a loop turns once per run, not once per sign, and nothing is tried again.
_S = f"[^{t.SPACE_CLASS}]++"
_S_ASCII = r"\S++"
_Q = r'"((?:[^"\\]++|\\[^\n])*+)"'
COMBINED = rf"^{_S} {_S} {_S} \[([^\]]+)\] {_Q} ([0-9]{{3}}|-) {_S} {_Q} {_Q}"
ALB = rf'^[a-z0-9]+ ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_S})(?: {_S}){{6}} ([0-9]{{3}}|-)(?: {_S}){{3}} "([^"]*+)" "([^"]*+)"'
CLOUDFRONT_DATA = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\t[0-9]{2}:[0-9]{2}:[0-9]{2}\t"

# The columns of a CloudFront standard log, in file order, and those that a record needs.
CLOUDFRONT_FIELDS = (
    "date time x-edge-location sc-bytes c-ip cs-method cs(Host) cs-uri-stem sc-status cs(Referer) cs(User-Agent) cs-uri-query cs(Cookie) "
    "x-edge-result-type x-edge-request-id x-host-header cs-protocol cs-bytes time-taken x-forwarded-for ssl-protocol ssl-cipher "
    "x-edge-response-result-type cs-protocol-version fle-status fle-encrypted-fields c-port time-to-first-byte x-edge-detailed-result-type "
    "sc-content-type sc-content-len sc-range-start sc-range-end"
).split()
CLOUDFRONT_NEEDED = ["date", "time", "cs-uri-stem", "sc-status", "cs(Referer)", "cs(User-Agent)"]


def line_format(line: Column) -> Column:
    """Format that a file's first non-blank line shows, or null. A combined or ALB line may have blanks before it here."""
    s = t.strip(line)
    return (
        F.when(F.startswith(s, F.lit("#Version:")) | F.startswith(s, F.lit("#Fields:")) | s.rlike(CLOUDFRONT_DATA), "cloudfront")
        .when(s.rlike(ALB), "alb")
        .when(s.rlike(COMBINED), "combined")
    )


@functools.cache
def _readers_patterns() -> tuple[re.Pattern, ...]:
    """The grammars as patterns of Python's own, for readers that see a file's first line."""
    return tuple(re.compile(re.sub(r"\\x\{([0-9a-f]{4})\}", r"\\u\1", p)) for p in (CLOUDFRONT_DATA, ALB, COMBINED))


def format_of(line: str) -> str | None:
    """What line_format() says, of one line in Python."""
    s = line.strip()
    cloudfront, alb, combined = _readers_patterns()
    if s.startswith(("#Version:", "#Fields:")) or cloudfront.match(s):
        return "cloudfront"
    return "alb" if alb.match(s) else "combined" if combined.match(s) else None


def header_spots(line: str) -> list[int] | None:
    """Where a ``#Fields:`` header puts the columns that a CloudFront record needs; null for one that lacks any."""
    at = {name: k for k, name in enumerate(line[8:].split())}
    return [at[n] for n in CLOUDFRONT_NEEDED] if all(n in at for n in CLOUDFRONT_NEEDED) else None


def is_blank(line: Column) -> Column:
    return t.strip(line) == ""


def _groups(pattern: str, groups: int) -> Column:
    """The pattern's groups in one text, parted by line breaks, which lines don't hold; the line itself if it doesn't match. The pattern runs once."""
    out = "\n".join(f"${k}" for k in range(1, groups + 1))
    # the full class of white space is a dozen tests per sign; where none of its rare members can occur, \S is the same
    plain = (F.octet_length("line") == F.length("line")) & ~F.col("line").rlike(r"[\x1c-\x1f]")
    return F.when(plain, F.regexp_replace("line", f"(?s){pattern.replace(_S, _S_ASCII)}.*$", out)).otherwise(F.regexp_replace("line", f"(?s){pattern}.*$", out))


def _header_names() -> Column:
    return F.array_remove(F.split(F.substring("line", 9, 1 << 30), f"[{t.SPACE_CLASS}]+"), "")


def _good_header() -> Column:
    return F.startswith("line", F.lit("#Fields:")) & F.forall(F.array(*[F.array_contains(_header_names(), F.lit(n)) for n in CLOUDFRONT_NEEDED]), lambda x: x)


def with_spots(lines: DataFrame) -> DataFrame:
    """CloudFront lines plus ``spots``: column positions of the last good ``#Fields:`` header above each line in its file.

    One window per file carries them, for lines that no reader has seen in order; the ``accesslog`` source emits them itself.
    """
    names = _header_names()
    spots = F.array(*[F.size(names) - F.array_position(F.reverse(names), F.lit(n)).cast("int") for n in CLOUDFRONT_NEEDED])
    above = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("_own", F.when(_good_header(), spots)).withColumn("spots", F.last("_own", ignorenulls=True).over(above)).drop("_own")


def _parse(lines: DataFrame, keep: list[str], fmt: str | None = None) -> DataFrame:
    """Outcome and fields of lines with ``fmt`` and ``spots``; what several fields are read from is a column first, so nothing is worked out twice.

    A format that is known for all lines leaves the other grammars out of the plan.
    """
    kinds = [fmt] if fmt else list(FORMATS)
    is_ = {k: F.lit(True) if fmt else F.col("fmt") == k for k in kinds}

    def pick(**by_kind) -> Column:
        """Each line's own of the columns by format; null for lines of none."""
        own = [(is_[k], c) for k, c in by_kind.items() if k in is_]
        out = own[0][1] if fmt else functools.reduce(lambda w, x: w.when(*x), own[1:], F.when(*own[0]))
        return out

    header, comment = F.startswith("line", F.lit("#Fields:")), F.startswith("line", F.lit("#"))
    f = lambda k: F.get("_f", F.lit(k))
    whole = lambda groups: (lambda parts: F.when(F.size(parts) == groups, parts))
    df = lines
    if "cloudfront" in kinds:
        standard = F.array(*[F.lit(CLOUDFRONT_FIELDS.index(n)) for n in CLOUDFRONT_NEEDED])
        df = df.withColumns({"_cols": F.when(is_["cloudfront"] & ~comment, F.split("line", "\t", -1)), "_at": F.coalesce("spots", standard)})
        # the six needed columns, or null if any is missing
        six = F.when(F.col("_cols").isNotNull(), F.array(*[F.get("_cols", F.get("_at", F.lit(k))) for k in range(6)]))
        df = df.withColumn("_six", F.when(F.forall(six, lambda x: x.isNotNull()), six))
    split = lambda pattern, groups: F.split(_groups(pattern, groups), "\n", -1)
    df = df.withColumn("_f", pick(combined=split(COMBINED, 5), alb=split(ALB, 4), cloudfront=F.col("_six") if "cloudfront" in kinds else None))
    if fmt != "cloudfront":
        df = df.withColumn("_f", pick(combined=whole(5)(F.col("_f")), alb=whole(4)(F.col("_f")), cloudfront=F.col("_f")))
    word = lambda c: F.get(F.split(c, " ", 3), F.lit(1))
    df = df.withColumns(
        {
            "_time": pick(combined=f(0), alb=f(0), cloudfront=F.concat(f(0), F.lit("T"), f(1), F.lit("+00:00"))),
            "_target": pick(combined=word(t.unescape(f(1))), alb=word(f(2)), cloudfront=f(2)),
            "_status": pick(combined=f(2), alb=f(1), cloudfront=f(3)),
            "_ref": pick(combined=t.unescape(f(3)), alb=F.lit(""), cloudfront=t.percent_decode(f(4))),
            "_ua": pick(combined=t.unescape(f(4)), alb=f(3), cloudfront=t.percent_decode(f(5))),
        }
    )
    df = df.withColumns({"ts": pick(combined=t.clf_time(F.col("_time")), alb=t.iso_time(F.col("_time")), cloudfront=t.iso_time(F.col("_time"))), "_path": u.normalize_path(F.col("_target"))})
    outcome = F.when(is_blank(F.col("line")), "blank")
    if "cloudfront" in kinds:
        outcome = outcome.when(is_["cloudfront"] & comment & (~header | _good_header()), "ignored")
    df = df.withColumn("outcome", outcome.when(F.col("ts").isNotNull(), "record").otherwise("malformed"))
    plain = F.coalesce("_path", F.lit("-"))
    fields = {
        "path": pick(combined=plain, alb=plain, cloudfront=t.percent_decode(F.col("_path"))),
        "status": t.status_code(F.col("_status")),
        "ua": t.dash_to_empty(F.col("_ua")),
        "referrer": t.dash_to_empty(F.col("_ref")),
    }
    record = F.col("outcome") == "record"
    return settle(df, keep, {"outcome": F.col("outcome"), "ts": F.when(record, F.col("ts"))} | {k: F.when(record, c) for k, c in fields.items()})


_KEPT = ["file", "line_no", "line"]


def parse_lines(lines: DataFrame, fmt: str | None = None, keep: list[str] = _KEPT) -> DataFrame:
    """Records of lines whose format is forced, or known for each in a column ``fmt`` (null: every line malformed), with the columns to keep."""
    if fmt is not None:
        if fmt not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        lines = lines.withColumn("fmt", F.lit(fmt))
    if "spots" in lines.columns:
        return _parse(lines, keep, fmt)
    plain = lambda df: df.withColumn("spots", F.lit(None).cast("array<int>"))
    if fmt is not None:
        return _parse(with_spots(lines) if fmt == "cloudfront" else plain(lines), keep, fmt)
    cloudfront = F.coalesce(F.col("fmt") == "cloudfront", F.lit(False))
    return _parse(plain(lines.where(~cloudfront)).unionByName(with_spots(lines.where(cloudfront))), keep)


def parse_source(rows: DataFrame, fmt: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed rows of the ``accesslog`` source, status rows included, with truncated and note: the first line of a file of unknown format, on its status row."""
    note = F.when(F.col("line_no").isNull() & F.col("fmt").isNull(), F.left("line", F.lit(300)))
    return parse_lines(rows.withColumn("note", note), fmt, keep=["file", "line_no", "truncated", "note", *keep])


def parse_combined(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, "combined")


def parse_alb(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, "alb")


def parse_cloudfront(lines: DataFrame) -> DataFrame:
    """Column positions come from the last good ``#Fields:`` header above a line in its file; a bad header is malformed and changes nothing."""
    return parse_lines(lines, "cloudfront")


def detect_by_file(lines: DataFrame) -> DataFrame:
    """(file, fmt): what each file's first non-blank line shows; null where no grammar fits."""
    first = lines.where(~is_blank(F.col("line"))).groupBy("file").agg(F.min_by("line", "line_no").alias("first"))
    return first.select("file", line_format(F.col("first")).alias("fmt"), F.col("first"))


def first_fit_by_file(lines: DataFrame) -> DataFrame:
    """(file, fmt): what the first line of each file shows that fits a grammar; files without such a line are not here."""
    names = F.array(*[F.lit(k) for k in FORMATS])
    fits = lines.select("file", "line_no", F.array_position(names, line_format(F.col("line"))).alias("at")).where("at is not null")
    return fits.groupBy("file").agg(F.min_by("at", "line_no").alias("at")).select("file", F.element_at(names, F.col("at").cast("int")).alias("fmt"))


def records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("outcome") == "record").select("file", "line_no", "ts", "path", "status", "ua", "referrer")


def file_stats(parsed: DataFrame) -> DataFrame:
    """(file, lines, records, skipped) of parsed lines."""
    return parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("outcome") == "record").alias("records"),
        F.count_if(F.col("outcome") == "malformed").alias("skipped"),
    )
