"""llms.txt summaries, HTML sniffing, and what a fetched file turned out to be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from botledger.functions.text import WEB_SPACE, web_trim

MAX_CHARS = 512_000
_BREAK = "\r\n|\r|\n"
#: A Markdown link; what is blank inside its address follows browsers. Possessive, so hostile texts cost linear space.
_BLANK = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_LINK = rf"\[[^\]\[\n]*+\]\([^){_BLANK}]++\)"


def llms_title(text: Column) -> Column:
    """Text of the first line that starts with ``# ``, or null if there is none or it is empty."""
    heads = F.filter(F.split(F.left(text, F.lit(MAX_CHARS)), _BREAK, -1), lambda x: F.startswith(x, F.lit("# ")))
    title = web_trim(F.substring(F.get(heads, F.lit(0)), 3, MAX_CHARS))
    return F.when(title != "", title)


def llms_links(text: Column) -> Column:
    """Number of Markdown links. A link's last opening bracket decides, so none inside its text is tried twice."""
    return F.regexp_count(F.left(text, F.lit(MAX_CHARS)), F.lit(_LINK)).cast("long")


def count_lines(text: Column) -> Column:
    """Lines of a text, a line break at its end not counted as the start of another."""
    n = F.regexp_count(text, F.lit(_BREAK)).cast("long")
    return F.when(text == "", F.lit(0).cast("long")).when(text.rlike(r"(?s)[\r\n]\z"), n).otherwise(n + 1)


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.ltrim(F.left(text, F.lit(256)), F.lit(WEB_SPACE)))
    out = F.lit(False)
    for start in ("<!doctype html", "<html", "<head", "<body"):
        out = out | F.startswith(head, F.lit(start))
    return out


def file_outcome(status: Column, text: Column) -> Column:
    """found, html, missing, server-error or unreachable (no status: the request failed)."""
    return (
        F.when(status.isNull(), "unreachable").when(status >= 500, "server-error").when(status >= 400, "missing")
        .when((status < 200) | (status >= 300) | text.isNull(), "unreachable").when(looks_like_html(text), "html").otherwise("found")
    )


def file_mark(outcome: Column) -> Column:
    return F.when(outcome.isin("found", "pasted"), "ok").when(outcome.isin("missing", "html"), "none").otherwise("warn")


def robots_line_kind(outcome: Column, status: Column) -> Column:
    """Which line reports on a robots.txt; null where no report is shown."""
    return (
        F.when(outcome.isin("found", "pasted", "html"), outcome)
        .when((outcome == "missing") & status.isin(404, 410), "missing").when(outcome == "missing", "unavailable")
    )


def llms_line_kind(outcome: Column, title: Column) -> Column:
    return (
        F.when(outcome == "unreachable", "unreachable").when(outcome == "pasted", "pasted")
        .when((outcome == "found") & title.isNull(), "found_untitled").when(outcome == "found", "found").otherwise("missing")
    )
