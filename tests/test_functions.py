"""Scalar functions on cases with the results they must have."""

import pytest
from pyspark.sql import functions as F

from botledger.functions import text as t
from botledger.functions import urls as u
from botledger.operators import sitefiles
from botledger.plans.engine import Engine

CASES = {}


def case(name, rows, f):
    CASES[name] = (rows, f)


case(
    "clf_time_utc",
    [
        ("28/Sep/2026:12:00:00 +0000", "2026-09-28T12:00:00+00:00"), ("28/Sep/2026:12:00:00 +0530", "2026-09-28T06:30:00+00:00"),
        ("01/Jan/2027:00:30:00 +0100", "2026-12-31T23:30:00+00:00"), ("31/Feb/2026:12:00:00 +0000", None), ("29/Feb/2024:23:59:59 -0500", "2024-03-01T04:59:59+00:00"),
        ("29/Feb/2023:00:00:00 +0000", None), ("28/Sep/2026:24:00:00 +0000", None), ("28/Sep/2026:12:00:60 +0000", None), ("28/Sep/2026:12:00:00 +2400", None),
        ("28/Sep/2026:12:00:00 -2359", "2026-09-29T11:59:00+00:00"), ("28/sep/2026:12:00:00 +0000", None), ("28/Okt/2026:12:00:00 +0000", None), ("", None), ("28/Sep/2026:12:00:00", None),
    ],
    lambda c: t.utc_text(t.clf_time(c)),
)
case(
    "iso_time_utc",
    [
        ("2026-09-28T08:15:30.999999Z", "2026-09-28T08:15:30+00:00"), ("2026-09-28T08:15:30Z", "2026-09-28T08:15:30+00:00"), ("2026-09-28T08:15:30.1Z", "2026-09-28T08:15:30+00:00"),
        ("2026-02-30T08:15:30Z", None), ("2026-09-28T08:15:60Z", None), ("2026-09-28 08:15:30Z", None), ("2026-09-28T08:15:30", None), ("0000-01-01T00:00:00Z", None), ("x", None),
    ],
    lambda c: t.utc_text(t.iso_time(c)),
)
case(
    "unescape",
    [
        ("plain", "plain"), ('Mozilla \\"quoted\\" x', 'Mozilla "quoted" x'), ("Mozilla \\x22hex\\x22", 'Mozilla "hex"'), ("caf\\xe9", "café"), ("\\x2", "x2"), ("a\\\\b", "a\\b"), ("end\\", "end\\"), ("\\xZZ", "xZZ"), ("", ""),
    ],
    t.unescape,
)
case(
    "percent_decode",
    [
        ("/caf%C3%A9", "/café"), ("a%20b+c", "a b+c"), ("%zz%4", "%zz%4"), ("%ff", "�"), ("%C3x", "�x"), ("100%", "100%"), ("%E2%82%AC", "€"), ("%e2%82", "�"), ("é%41", "éA"), ("", ""), ("%25%32%30", "%20"),
    ],
    t.percent_decode,
)
case(
    "url_host",
    [
        ("https://Example.com/a", "example.com"), ("https://u:p@h.example:8/x", "h.example"), ("https://a@b@c.example/", "c.example"), ("https:chatgpt.com", None), ("//h/x", None), ("h.example", None),
        ("https://[::1]:80/x", "::1"), ("https://[::1/x", None), ("https:///x", None), ("https://h.ex\tample/", "h.example"), ("https://h.example?x", "h.example"), ("https://h\\@e.example/", "e.example"), ("1http://h/", None),
    ],
    u.url_host,
)
case(
    "normalize_host",
    [("WWW.Example.COM.", "example.com"), ("www.www.x", "www.x"), (" x.example.. ", "x.example"), ("www", "www"), ("a" * 300 + "." * 3000, "a" * 300), ("", "")],
    u.normalize_host,
)
case(
    "domain_input",
    [
        ("example.com", "https://example.com"), (" HTTP://Example.com:80/x ", "https://example.com"), ("https://example.com:8443/x?y", "https://example.com:8443"), ("example.com.", "https://example.com"),
        ("", "empty"), ("  ", "empty"), ("ftp://example.com", "invalid"), ("127.0.0.1", "ip"), ("https://[::1]/", "ip"), ("localhost", "local"), ("intranet", "local"), ("a.local", "local"),
        ("x.home.arpa", "local"), ("https://exa mple.com", "invalid"), ("https://example.com:99999", "invalid"), ("https://", "invalid"), ("user@example.com/path", "https://example.com"),
        ("münchen.example", "https://xn--mnchen-3ya.example"), (" https://user@STRAßE.example:8443/xü ", "https://xn--strae-oqa.example:8443"), ("日本。example", "https://xn--wgv71a.example"),
        ("ｅxample.com", "https://example.com"), ("abü.example", "invalid"), ("example.com/ü", "https://example.com"), ("%65xample.com", "https://example.com"),
        ("127.1", "ip"), ("0x7f.0.0.1", "ip"), ("2130706433", "ip"), ("0300.0250.1", "ip"), ("10.0.0.1.", "ip"), ("256.1.1.1", "invalid"), ("1.2.3.4.5", "invalid"), ("1.2.3.09", "invalid"), ("example.7", "invalid"),
        ("1.2.3.4.example", "https://1.2.3.4.example"),
    ],
    lambda c: F.transform(F.array(u.site_input(c)), lambda s: F.coalesce(s["origin"], s["reason"]))[0],
)
case("check_link", [("localhost", "/en/?check=localhost"), ("https://a.example:8/x?y=1&z", "/en/?check=https%3A%2F%2Fa.example%3A8%2Fx%3Fy%3D1%26z"), ("bü.example", "/en/?check=b%C3%BC.example")], lambda c: u.check_link(F.lit("/en/"), c))
case("check_value", [("https://chatgpt.com/", "url"), ("GPTBot/1.0", "ua"), ("see https://x.example/", "ua"), (" https://x.example/a ", "url"), ("https://", "ua")], lambda c: F.when(u.is_url(c), "url").otherwise("ua"))
case(
    "bare_host_hint",
    [("chatgpt.com", "https://chatgpt.com/"), ("chatgpt.com/", "https://chatgpt.com/"), ("h.example:8080", "https://h.example:8080/"), ("-a.example", None), ("localhost", None), ("a b.example", None), ("a..b", None)],
    u.bare_host_hint,
)
case(
    "check_param",
    [("/en/?check=dev.to", "dev.to"), ("/?a=1&check=https%3A%2F%2FExample.com%3A8443%2Fx", "example.com:8443"), ("/?check=", None), ("/?x=check", None), ("/?check=localhost", None)],
    u.check_param,
)
case("count_lines", [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb", 2), ("a\r\rb\n", 3), ("\n", 1), ("\n\n", 2)], sitefiles.count_lines)


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    rows, f = CASES[name]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i long, input string")
    got = {r["i"]: r["result"] for r in df.select("i", f(F.col("input")).cast("string").alias("result")).collect()}
    assert [got[i] for i in range(len(rows))] == [None if r[1] is None else str(r[1]) for r in rows]


FETCHED = [
    (1, 200, "User-agent: *", "found", "ok", "found"), (2, 200, "<html>", "html", "none", "html"), (3, 404, "x", "missing", "none", "missing"), (4, 410, None, "missing", "none", "missing"),
    (5, 403, "x", "missing", "none", "unavailable"), (6, 500, "x", "server-error", "warn", None), (7, None, None, "unreachable", "warn", None), (8, 302, "x", "unreachable", "warn", None), (9, 204, "", "found", "ok", "found"),
]


def test_outcomes_of_files(spark):
    df = spark.createDataFrame([r[:3] for r in FETCHED], "id long, status int, text string").withColumn("outcome", sitefiles.file_outcome(F.col("status"), F.col("text")))
    rows = df.select("id", "outcome", sitefiles.file_mark(F.col("outcome")), sitefiles.robots_line_kind(F.col("outcome"), F.col("status"))).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(r[0], *r[3:]) for r in FETCHED]


LLMS_LINES = [("found", "T", "found"), ("found", None, "found_untitled"), ("pasted", None, "pasted"), ("missing", None, "missing"), ("html", None, "missing"), ("server-error", None, "missing"), ("unreachable", None, "unreachable")]


def test_kinds_of_llms_lines(spark):
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(LLMS_LINES)], "id long, outcome string, title string")
    assert [r[0] for r in df.orderBy("id").select(sitefiles.llms_line_kind(F.col("outcome"), F.col("title"))).collect()] == [r[2] for r in LLMS_LINES]


PASTED = [
    '198.51.100.1 - - [03/Mar/2026:10:00:00 +0000] "GET /p1?x HTTP/1.1" 200 5 "-" "GPTBot/1.1"', "", "broken",
    '198.51.100.1 - - [03/Mar/2026:10:00:01 +0000] "GET /p2 HTTP/1.1" 404 5 "https://claude.ai/" "Mozilla"',
]


def test_pasted_text(spark):
    rows = Engine(spark).parse_text("\r".join(PASTED[:2]) + "\r\n" + "\n".join(PASTED[2:])).orderBy("line_no").select("line_no", "outcome", "path", "status").collect()
    assert [tuple(r) for r in rows] == [(1, "record", "/p1", 200), (2, "blank", None, None), (3, "malformed", None, None), (4, "record", "/p2", 404)]
