"""Scalar text functions as native columns: trimming, escapes, percent-decoding, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space around values (str.isspace in Python; not the BOM).
_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = "".join(map(chr, _CODES))
#: The same as a Java character class, without brackets; few ranges, since each is a test per sign.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space as browsers trim it: with the BOM, without U+001C to U+001F and U+0085.
WEB_SPACE = "".join(chr(c) for c in _CODES if not 0x1C <= c <= 0x1F and c != 0x85) + "\ufeff"

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_CLF = r"^([0-9]{2})/(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/([0-9]{4}):([0-9]{2}):([0-9]{2}):([0-9]{2}) ([+-])([0-9]{2})([0-9]{2})"
_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?(?:Z|\+00:00)$"


def let(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f mentions it."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def web_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WEB_SPACE))


def dash_to_empty(c: Column) -> Column:
    return F.when(c == "-", F.lit("")).otherwise(c)


def status_code(c: Column) -> Column:
    """A three-digit status as a number, anything else as 0."""
    return F.when(c.rlike("^[0-9]{1,9}$"), c.try_cast("int")).otherwise(F.lit(0))


def unescape(c: Column) -> Column:
    r"""Undo ``\"`` and ``\xHH`` (a Latin-1 code point) in a quoted log field."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\x[0-9A-Fa-f]{2}|\\[^\n]|[^\\]+|\\)"), F.lit(1))

    def undo(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.chr(F.conv(F.substring(x, 3, 2), 16, 10).cast("long")))
            .when(F.startswith(x, F.lit("\\")) & (F.length(x) == 2), F.substring(x, 2, 1))
            .otherwise(x)
        )

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, undo), "")).otherwise(c)


def percent_decode(c: Column) -> Column:
    """``%XX`` as UTF-8 bytes; what isn't valid becomes U+FFFD, other escapes and ``+`` stay."""
    pieces = F.regexp_extract_all(c, F.lit("(?s)((?:%[0-9A-Fa-f]{2})+|[^%]+|%)"), F.lit(1))
    raw = F.transform(
        pieces, lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}"), F.unhex(F.replace(x, F.lit("%"), F.lit("")))).otherwise(F.to_binary(x, F.lit("utf-8")))
    )
    joined = F.aggregate(raw, F.to_binary(F.lit(""), F.lit("utf-8")), lambda acc, x: F.concat(acc, x))
    return F.when(F.contains(c, F.lit("%")), F.make_valid_utf8(joined.cast("string"))).otherwise(c)


def _number(c: Column, start: int, size: int) -> Column:
    return F.substring(c, start, size).try_cast("int")


def _moment(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A time without zone (UTC by convention), or null unless date and time exist; second 60 does not. Made of numbers: a cast from text costs several times as much."""
    return F.when((year >= 1) & (second < 60), F.try_make_timestamp_ntz(year, month, day, hour, minute, second))


def clf_time(c: Column) -> Column:
    """``28/Sep/2026:12:00:00 +0200`` in UTC (TIMESTAMP_NTZ), null where it isn't a real time.

    One pattern fixes the shape; the parts are then read by their places.
    """
    month = F.ceil(F.instr(F.lit(_MONTHS), F.substring(c, 4, 3)) / 3).cast("int")
    minutes = _number(c, 23, 2) * 60 + _number(c, 25, 2)
    local = _moment(_number(c, 8, 4), month, _number(c, 1, 2), _number(c, 13, 2), _number(c, 16, 2), _number(c, 19, 2).cast("decimal(16,6)"))
    sign = F.when(F.substring(c, 22, 1) == "-", 1).otherwise(-1)
    return F.when(c.rlike(_CLF) & (minutes < 1440), local + F.make_dt_interval(mins=sign * minutes))


def iso_time(c: Column) -> Column:
    """``2026-09-28T08:15:30.999999Z`` (TIMESTAMP_NTZ in UTC), null where it isn't a real time; digits past the sixth are dropped."""
    fraction = F.rpad(F.substring(F.regexp_extract(F.substring(c, 20, 20), r"^\.([0-9]+)", 1), 1, 6), 6, "0")
    second = F.concat(F.substring(c, 18, 2), F.lit("."), fraction).try_cast("decimal(16,6)")
    return F.when(c.rlike(_ISO), _moment(_number(c, 1, 4), _number(c, 6, 2), _number(c, 9, 2), _number(c, 12, 2), _number(c, 15, 2), second))


def utc_text(c: Column) -> Column:
    """A UTC time as ISO 8601 with whole seconds (truncated) and +00:00."""
    return F.concat(F.replace(F.substring(c.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("+00:00"))
