"""Registered queries of the log engine and their DuckDB counterparts.

The test tables hold no access logs, so both sides derive the same requests from ``events``:
the query renders log lines from them and parses these back; the oracle works from the fields
the lines were rendered from. Scalar functions run over texts made of a table's rows.
"""

from __future__ import annotations

import atexit
import functools
import gzip
import hashlib
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botledger.functions import text as t
from botledger.functions import urls as u
from botledger.operators import classify, lines, report, robots, rulesets, sessions, sitefiles
from botledger.sources import catalogue, logfiles, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({names})"


# ------------------------------------------------------------------ requests

_AGENTS = [
    (f"Mozilla/5.0 (compatible; {c[4].upper() if c[0] % 2 else c[4]}/1.{c[0]}; +https://bot.example/{c[0]})", c[1]) for c in catalogue.CRAWLERS if not c[7]
] + [
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Safari/605.1.15", None),
    ("curl/8.5.0", None),
    ('Mozilla/5.0 "quoted" ClaudeBot/1.0', "anthropic-claudebot"),
    ("Mozilla/5.0 (compatible; Applebot-Extended/0.3)", "apple-applebot"),
    ("Mozilla/5.0 (compatible; Google-Extended)", None),
    ("GPTBot and ChatGPT-User together", "openai-chatgpt-user"),
    ("", None),
]
_REFERRERS = [
    ("https://chatgpt.com/", "chatgpt"),
    ("https://chat.openai.com/c/1?x=y", "chatgpt"),
    ("https://www.perplexity.ai/search", "perplexity"),
    ("https://user:pw@claude.ai:99999/chat", "claude"),
    ("https://gemini.google.com./app", "gemini"),
    ("https://notebooklm.google.com", "notebooklm"),
    ("https://sub.copilot.microsoft.com/", "copilot"),
    ("HTTPS://GROK.COM/", "grok"),
    ("https://a.b.c.x.ai/q#f", "grok"),
    ("https://www.google.com/search?q=claude.ai", None),
    ("https://notclaude.ai/", None),
    ("https://claude.ai.evil.example/", None),
    ("https:chatgpt.com", None),
    ("//chatgpt.com/", None),
    ("chatgpt.com", None),
    ("https://meta.ai", "meta-ai"),
    ("https://duck.ai/x", "duck-ai"),
    ("https://ai/", None),
    ("https://you.com/", "you-com"),
    ("", None),
    ("", None),
]

#: Columns of a derived request, in SQL that both engines read. Broken lines come every 97 events.
_REQ = f"""
SELECT e.event_id, e.ts, date_trunc('second', e.ts) AS sec, e.user_id,
  'log' || CAST(e.user_id % 4 AS STRING) AS file,
  '/' || e.event_type || '/' || CAST(e.user_id % 50 AS STRING) AS path,
  CASE e.event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '?k=' || CAST(e.event_id AS STRING) WHEN 2 THEN '#top' ELSE '?a=1#b' END AS tail,
  CASE WHEN e.event_id % 7 = 3 THEN 'https://www.example.com:443' ELSE '' END AS origin,
  CASE WHEN e.event_id % 11 = 5 THEN 0 WHEN e.event_id % 3 = 0 THEN 404 ELSE 200 END AS status,
  a.ua, a.crawler, r.referrer, CASE WHEN a.crawler IS NULL THEN r.product END AS product, r.product AS any_product,
  e.event_id % 97 = 13 AS broken
FROM events_ e
JOIN {values([(i, *x) for i, x in enumerate(_AGENTS)], 'i, ua, crawler').replace('AS v(', 'AS a(')} ON a.i = e.event_id % {len(_AGENTS)}
JOIN {values([(i, *x) for i, x in enumerate(_REFERRERS)], 'i, referrer, product').replace('AS v(', 'AS r(')} ON r.i = (e.event_id * 7 + e.user_id) % {len(_REFERRERS)}
"""


def req_sql() -> str:
    return _REQ.replace("events_", "events")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REQ.replace("events_", "{events}"), events=table(spark, sf_dir, "events"))


def _or_dash(c: str):
    return F.when(F.col(c) == "", F.lit("-")).otherwise(F.col(c))


def combined_lines(req: DataFrame) -> DataFrame:
    """Combined lines: half the times with offset +0530, quotes escaped as Apache or nginx do."""
    odd = F.col("event_id") % 2 == 1
    clock = F.date_format(F.when(odd, F.col("sec") + F.make_dt_interval(mins=F.lit(330))).otherwise(F.col("sec")), "dd/MMM/yyyy:HH:mm:ss")
    ua = F.replace(F.col("ua"), F.lit('"'), F.when(odd, F.lit('\\"')).otherwise(F.lit("\\x22")))
    line = F.concat(
        F.lit("203.0.113."), (F.col("user_id") % 256).cast("string"), F.lit(" - - ["), clock, F.when(odd, F.lit(" +0530")).otherwise(F.lit(" +0000")),
        F.lit('] "GET '), "origin", "path", "tail", F.lit(' HTTP/1.1" '), F.when(F.col("status") == 0, F.lit("-")).otherwise(F.col("status").cast("string")),
        F.lit(' 512 "'), _or_dash("referrer"), F.lit('" "'), F.when(F.col("ua") == "", F.lit("-")).otherwise(ua), F.lit('"'),
    )
    return req.select("file", F.col("event_id").alias("line_no"), F.when(F.col("broken"), F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(line).alias("line"))


def alb_lines(req: DataFrame) -> DataFrame:
    ua = F.when(F.col("ua") == "", F.lit("-")).otherwise(F.replace(F.col("ua"), F.lit('"'), F.lit("'")))
    stamp = F.concat(F.replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.lit("T")), F.lit("Z"))
    line = F.concat(
        F.lit("h2 "), stamp, F.lit(" app/web/1 203.0.113.9:5 10.0.0.1:80 0.0 0.1 0.0 "), F.when(F.col("status") == 0, F.lit("-")).otherwise(F.col("status").cast("string")),
        F.lit(' 200 34 366 "GET https://www.example.com:443'), "path", "tail", F.lit(' HTTP/2.0" "'), ua, F.lit('" TLS13 x arn:1'),
    )
    return req.select("file", F.col("event_id").alias("line_no"), F.when(F.col("broken"), F.concat(F.lit("h2 not-a-time "), F.col("event_id").cast("string"))).otherwise(line).alias("line"))


_CF_SHORT = "date time cs-uri-stem sc-status cs(Referer) cs(User-Agent)"


def cloudfront_rows(req: DataFrame) -> DataFrame:
    """Data lines: log3 has the standard columns, the others those of the short header."""
    quote = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit('"'), F.lit("%22")), F.lit("#"), F.lit("%23"))
    day, clock = F.date_format("sec", "yyyy-MM-dd"), F.date_format("sec", "HH:mm:ss")
    stem, status = F.concat("path", F.lit("/caf%C3%A9")), F.when(F.col("status") == 0, F.lit("-")).otherwise(F.col("status").cast("string"))
    ref, ua = quote(_or_dash("referrer")), F.when(F.col("ua") == "", F.lit("-")).otherwise(quote(F.col("ua")))
    short = F.concat_ws("\t", day, clock, stem, status, ref, ua)
    full = F.concat_ws("\t", day, clock, F.lit("FRA1"), F.lit("1"), F.lit("1.2.3.4"), F.lit("GET"), F.lit("h"), stem, status, ref, ua, F.lit("-"))
    line = F.when(F.col("broken"), F.concat(F.lit("2024-13-40\tx\t"), F.col("event_id").cast("string"))).when(F.col("file") == "log3", full).otherwise(short)
    return req.select("file", (F.col("event_id") + 10).alias("line_no"), line.alias("line"))


def cloudfront_lines(req: DataFrame) -> DataFrame:
    """log0 to log2 start with a short header and get a useless one among their lines; log3 has the standard columns and no header."""
    body = cloudfront_rows(req)
    heads = req.sparkSession.createDataFrame(
        [(f"log{k}", n, x) for k in range(3) for n, x in ((1, "#Version: 1.0"), (2, f"#Fields: {_CF_SHORT}"))], "file string, line_no long, line string"
    )
    bad = req.where("event_id = 9").select(F.explode(F.array(*[F.lit(f"log{k}") for k in range(3)])).alias("file"), F.lit(15).cast("long").alias("line_no"), F.lit("#Fields: date time").alias("line"))
    return body.unionByName(heads).unionByName(bad)


_PARSED = ["file", "line_no", "outcome", "ts_text", "path", "status", "ua", "referrer"]


def _flat(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).select(*_PARSED)


def _truth(ts: str, path: str, ua: str, referrer: str, line_no: str = "event_id") -> str:
    pick = lambda x: f"CASE WHEN NOT broken THEN {x} END"
    return f"""SELECT file, {line_no} AS line_no, CASE WHEN broken THEN 'malformed' ELSE 'record' END AS outcome, {pick(f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')")} AS ts_text,
    {pick(path)} AS path, {pick('CAST(status AS INTEGER)')} AS status, {pick(ua)} AS ua, {pick(referrer)} AS referrer FROM ({req_sql()})"""


@query("parse_combined", _truth("sec", "path", "ua", "referrer"))
def parse_combined(spark, sf_dir):
    return _flat(lines.parse_combined(combined_lines(requests(spark, sf_dir))))


@query("parse_alb", _truth("ts", "path", "replace(ua, '\"', '''')", "''"))
def parse_alb(spark, sf_dir):
    return _flat(lines.parse_alb(alb_lines(requests(spark, sf_dir))))


@query(
    "parse_cloudfront",
    _truth("sec", "path || '/café'", "ua", "referrer", "event_id + 10")
    + """ UNION ALL SELECT 'log' || CAST(k AS VARCHAR), n, o, NULL, NULL, NULL, NULL, NULL
    FROM (VALUES (0), (1), (2)) AS f(k), (VALUES (1, 'ignored'), (2, 'ignored'), (15, 'malformed')) AS h(n, o)""",
)
def parse_cloudfront(spark, sf_dir):
    return _flat(lines.parse_cloudfront(cloudfront_lines(requests(spark, sf_dir))))


@query(
    "detect_format",
    f"""SELECT event_id AS line_no, CASE WHEN broken THEN NULL WHEN event_id % 3 = 0 THEN 'combined' WHEN event_id % 3 = 1 THEN 'alb' ELSE 'cloudfront' END AS fmt
    FROM ({req_sql()}) UNION ALL SELECT * FROM {values([(-1, 'cloudfront'), (-2, 'cloudfront'), (-3, None), (-4, 'combined'), (-5, None)], 'a, b')}""",
)
def detect_format(spark, sf_dir):
    req = requests(spark, sf_dir)
    which = F.col("line_no") % 3
    rows = combined_lines(req).where(which == 0).unionByName(alb_lines(req).where(which == 1))
    cf = cloudfront_lines(req.withColumn("file", F.lit("log3"))).where("file = 'log3'").withColumn("line_no", F.col("line_no") - 10).where(which == 2)
    cf = cf.withColumn("line", F.when(F.startswith("line", F.lit("2024-13")), F.lit("?")).otherwise(F.col("line")))
    odd = spark.createDataFrame(
        [("x", -1, "#Version: 1.0"), ("x", -2, " \t#Fields: date"), ("x", -3, "﻿#Version: 1.0"), ("x", -4, '  h - - [x] "a" - 0 "b" "c" more'), ("x", -5, "")],
        "file string, line_no long, line string",
    )
    return rows.unionByName(cf).unionByName(odd).select("line_no", lines.line_format(F.col("line")).alias("fmt"))


# ------------------------------------------------------------------ scalar functions


def _told(spark: SparkSession, sf_dir: str, name: str, sql: str, f: Callable) -> DataFrame:
    """id and the function's result, as text, for each row of a table; sql has the columns id and input."""
    rows = spark.sql(sql.replace(f"{name}_", "{" + name + "}"), **{name: table(spark, sf_dir, name)})
    return rows.select("id", f(F.col("input")).cast("string").alias("result"))


def over(query_name: str, name: str, made: str, f: Callable, truth: str) -> None:
    """A query that applies a scalar function to texts made of a table's rows; ``made`` gives id and input, in SQL that both engines read, and ``truth`` the result, in DuckDB's, from the same rows."""
    QUERIES[query_name] = lambda spark, sf_dir: _told(spark, sf_dir, name, made, f)
    ORACLE[query_name] = truth


#: Times of events as logs have them: five offsets, one of which doesn't exist; days and hours that don't exist.
over(
    "clf_time_utc", "events",
    """SELECT event_id AS id, CASE event_id % 11 WHEN 4 THEN '31/Feb/2024:' || date_format(ts, 'HH:mm:ss') || ' +0000' WHEN 5 THEN date_format(ts, 'dd/MMM/yyyy') || ':24:00:00 +0000' WHEN 6 THEN date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')
      ELSE CASE event_id % 5 WHEN 0 THEN date_format(ts, 'dd/MMM/yyyy:HH:mm:ss') || ' +0000' WHEN 1 THEN date_format(ts + INTERVAL '330' MINUTE, 'dd/MMM/yyyy:HH:mm:ss') || ' +0530'
      WHEN 2 THEN date_format(ts - INTERVAL '300' MINUTE, 'dd/MMM/yyyy:HH:mm:ss') || ' -0500' WHEN 3 THEN date_format(ts + INTERVAL '1439' MINUTE, 'dd/MMM/yyyy:HH:mm:ss') || ' +2359'
      ELSE date_format(ts, 'dd/MMM/yyyy:HH:mm:ss') || ' +2400' END END AS input FROM events_""",
    lambda c: t.utc_text(t.clf_time(c)),
    "SELECT event_id AS id, CASE WHEN event_id % 11 NOT IN (4, 5, 6) AND event_id % 5 <> 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS result FROM events",
)
over(
    "iso_time_utc", "events",
    """SELECT event_id AS id, CASE event_id % 13 WHEN 4 THEN '2023-02-29T' || date_format(ts, 'HH:mm:ss') || 'Z' WHEN 5 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') || 'Z' WHEN 6 THEN replace(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', 'T')
      WHEN 7 THEN date_format(ts, 'yyyy-MM-dd') || 'T08:15:60Z'
      ELSE replace(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', 'T') || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.9' WHEN 2 THEN '.' || date_format(ts, 'SSSSSS') ELSE '.999999999' END || CASE event_id % 3 WHEN 0 THEN '+00:00' ELSE 'Z' END END AS input FROM events_""",
    lambda c: t.utc_text(t.iso_time(c)),
    "SELECT event_id AS id, CASE WHEN event_id % 13 NOT IN (4, 5, 6, 7) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS result FROM events",
)


def _escaped(c):
    """Quotes and backslashes as logs escape them, signs of Latin-1 by their codes."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for sign in "äöüßéèêçáíóúñ":
        out = F.replace(out, F.lit(sign), F.lit(f"\\x{ord(sign):02x}"))
    return out


over("unescape", "documents", "SELECT doc_id AS id, text AS input FROM documents_", lambda c: F.md5(t.unescape(_escaped(c)).cast("binary")), "SELECT doc_id AS id, md5(text) AS result FROM documents")
over(
    "percent_decode", "documents",
    "SELECT doc_id AS id, replace(url_encode(text), '+', '%20') || CASE doc_id % 3 WHEN 0 THEN '%zz%4+' WHEN 1 THEN '%ff%C3x' ELSE '' END AS input FROM documents_",
    lambda c: F.md5(t.percent_decode(c).cast("binary")),
    "SELECT doc_id AS id, md5(text || CASE doc_id % 3 WHEN 0 THEN '%zz%4+' WHEN 1 THEN chr(65533) || chr(65533) || 'x' ELSE '' END) AS result FROM documents",
)

#: Pages with the parts of their addresses.
_PARTS = "(SELECT page_id AS id, url, host, substr(url, length(regexp_extract(url, '^(https?://[^/?#]*)', 1)) + 1) AS rest FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages_))"
_PARTS_SQL = _PARTS.replace("pages_", "pages")
over(
    "url_host", "pages",
    f"""SELECT id, CASE id % 7 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN 'https://u:p@x@' || host || ':99999' || rest WHEN 3 THEN '//' || host || rest WHEN 4 THEN 'https:' || host WHEN 5 THEN 'ftp://[' || host || ']:8' || rest
    ELSE 'https://[' || host || rest END AS input FROM {_PARTS}""",
    u.url_host, f"SELECT id, CASE WHEN id % 7 IN (0, 1, 2, 5) AND host <> '' THEN lower(host) END AS result FROM {_PARTS_SQL}",
)
over(
    "normalize_host", "pages", f"SELECT id, CASE id % 3 WHEN 0 THEN host WHEN 1 THEN '  WWW.' || upper(host) || '...' ELSE 'www.' || host || '. ' END AS input FROM {_PARTS}",
    u.normalize_host, f"SELECT id, CASE WHEN id % 3 = 0 AND host LIKE 'www.%' THEN substr(host, 5) ELSE host END AS result FROM {_PARTS_SQL}",
)
over(
    "domain_input", "pages",
    f"""SELECT id, CASE id % 10 WHEN 0 THEN url WHEN 1 THEN host WHEN 2 THEN ' HTTP://' || upper(host) || ':80/x ' WHEN 3 THEN 'ftp://' || host WHEN 4 THEN host || ':99999' WHEN 5 THEN '10.0.' || CAST(id % 256 AS STRING) || '.1'
    WHEN 6 THEN 'intranet.' || CAST(id AS STRING) || '.local' WHEN 7 THEN 'user@bücher.' || host || ':8443' || rest WHEN 8 THEN '  ' ELSE CAST(id AS STRING) || '.0.0.300' END AS input FROM {_PARTS}""",
    lambda c: F.transform(F.array(u.site_input(c)), lambda s: F.coalesce(s["origin"], s["reason"]))[0],
    f"""SELECT id, CASE WHEN id % 10 IN (0, 1, 2) THEN 'https://' || host WHEN id % 10 IN (3, 4, 9) THEN 'invalid' WHEN id % 10 = 5 THEN 'ip' WHEN id % 10 = 6 THEN 'local' WHEN id % 10 = 8 THEN 'empty'
    ELSE 'https://xn--bcher-kva.' || host || ':8443' END AS result FROM {_PARTS_SQL}""",
)
over("check_link", "pages", "SELECT page_id AS id, url AS input FROM pages_", lambda c: u.check_link(F.lit("/en/"), c), "SELECT page_id AS id, '/en/?check=' || url_encode(url) AS result FROM pages")
over(
    "check_value", "pages", f"SELECT id, CASE id % 5 WHEN 0 THEN url WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN 'see ' || url WHEN 3 THEN host ELSE url || ' x' END AS input FROM {_PARTS}",
    lambda c: F.when(u.is_url(c), "url").otherwise("ua"), f"SELECT id, CASE WHEN id % 5 < 2 THEN 'url' ELSE 'ua' END AS result FROM {_PARTS_SQL}",
)
over(
    "bare_host_hint", "pages",
    f"SELECT id, CASE id % 6 WHEN 0 THEN host WHEN 1 THEN host || '/' WHEN 2 THEN host || ':8080' WHEN 3 THEN '-' || host WHEN 4 THEN substring_index(host, '.', 1) ELSE url END AS input FROM {_PARTS}",
    u.bare_host_hint, f"SELECT id, CASE id % 6 WHEN 0 THEN 'https://' || host || '/' WHEN 1 THEN 'https://' || host || '/' WHEN 2 THEN 'https://' || host || ':8080/' END AS result FROM {_PARTS_SQL}",
)
over(
    "check_param", "pages",
    f"""SELECT id, CASE id % 6 WHEN 0 THEN '/en/?check=' || host WHEN 1 THEN '/?a=1&check=https%3A%2F%2F' || upper(host) || '%3A8443%2Fx#y' WHEN 2 THEN '/?check=' WHEN 3 THEN '/?x=check&uncheck=' || host WHEN 4 THEN '/?check=local' || CAST(id AS STRING)
    ELSE '/?check=' || url_encode(url) || '&b' END AS input FROM {_PARTS}""",
    u.check_param, f"SELECT id, CASE id % 6 WHEN 0 THEN host WHEN 1 THEN host || ':8443' WHEN 5 THEN host END AS result FROM {_PARTS_SQL}",
)
over(
    "count_lines", "conversations",
    "SELECT conv_id * 1000 + turn AS id, replace(replace(text, chr(10), ''), ' ', CASE turn % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) ELSE chr(13) || chr(10) END) AS input FROM conversations_",
    sitefiles.count_lines,
    """SELECT conv_id * 1000 + turn AS id, CAST(CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + CASE WHEN x LIKE '% ' THEN 0 ELSE 1 END END AS VARCHAR) AS result
    FROM (SELECT *, replace(text, chr(10), '') AS x FROM conversations)""",
)


@query(
    "normalize_path",
    r"""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages)
    UNION ALL SELECT * FROM """
    + values([(-1, "/pricing"), (-2, "/a"), (-3, "/"), (-4, "-"), (-5, "/"), (-6, "/x"), (-7, "ftp://h/x"), (-8, "/a%20b"), (-9, "*")], "a, b"),
)
def normalize_path(spark, sf_dir):
    odd = spark.createDataFrame(
        [(-1, "/pricing?utm=x"), (-2, "/a#b?c"), (-3, "https://www.example.com:443"), (-4, "http://[::1/x"), (-5, "?q"), (-6, "http://[::1]/x#y"), (-7, "ftp://h/x"), (-8, "/a%20b"), (-9, "*")],
        "page_id long, url string",
    )
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(odd).select("page_id", u.normalize_path(F.col("url")).alias("path"))


# ------------------------------------------------------------------ classification


@query("classify_ua", f"SELECT event_id, crawler AS id FROM ({req_sql()})")
def classify_ua(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", classify.crawler_id(F.col("ua")).alias("id"))


@query("classify_referrer", f"SELECT event_id, any_product AS id FROM ({req_sql()})")
def classify_referrer(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", classify.referral_id(F.col("referrer")).alias("id"))


@query("classify_own_host", f"SELECT event_id, CASE WHEN referrer NOT LIKE '%perplexity.ai/%' THEN any_product END AS id FROM ({req_sql()})")
def classify_own_host(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", classify.referral_id(F.col("referrer"), "WWW.Perplexity.ai.").alias("id"))


_DIMS_C = values([c[1:7] for c in catalogue.CRAWLERS], "id, vendor, vendor_name, token, purpose, ai_specific").replace("AS v(", "AS c(")
_DIMS_R = values([r[1:5] for r in catalogue.REFERRERS], "id, vendor, vendor_name, product").replace("AS v(", "AS p(")


@query(
    "classify_request",
    f"""SELECT event_id, CASE WHEN q.crawler IS NOT NULL THEN 'crawler' WHEN q.product IS NOT NULL THEN 'referral' END AS kind, coalesce(q.crawler, q.product) AS id,
    coalesce(c.vendor, p.vendor) AS vendor, c.token, p.product, c.purpose, CASE WHEN c.id IS NULL AND p.id IS NULL THEN NULL ELSE coalesce(c.ai_specific, TRUE) END AS ai_specific
    FROM ({req_sql()}) q LEFT JOIN {_DIMS_C} ON c.id = q.crawler LEFT JOIN {_DIMS_R} ON p.id = q.product""",
)
def classify_request(spark, sf_dir):
    tagged = classify.classify(requests(spark, sf_dir).drop("product"))
    m = classify.match_struct(F.col("crawler_id"), F.col("referral_id"))
    return tagged.withColumn("m", m).select("event_id", "m.kind", "m.id", "m.vendor", "m.token", "m.product", "m.purpose", "m.ai_specific")


@query("log_line", f"""SELECT event_id, 'ai_traffic kind=' || CASE WHEN crawler IS NOT NULL THEN 'crawler' ELSE 'referral' END || ' id=' || coalesce(crawler, product) || ' path=' || path AS line
    FROM ({req_sql()}) WHERE crawler IS NOT NULL OR product IS NOT NULL""")
def log_line(spark, sf_dir):
    from botledger.streaming import live

    hits = live.tag(requests(spark, sf_dir).drop("product")).where("ai_traffic is not null")
    return hits.select("event_id", classify.log_line(F.col("ai_traffic.kind"), F.col("ai_traffic.id"), F.col("path")).alias("line"))


# ------------------------------------------------------------------ report


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.parse_combined(combined_lines(requests(spark, sf_dir)))


def _tally(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return report.tally(lines.records(_parsed(spark, sf_dir)), **options)


_GOOD = f"(SELECT * FROM ({req_sql()}) WHERE NOT broken)"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@query(
    "report_summary",
    f"""SELECT count(*) FILTER (NOT broken) AS records, count(*) FILTER (broken) AS skipped,
    count(*) FILTER (NOT broken AND c.ai_specific) AS ai_crawler_requests, count(*) FILTER (NOT broken AND product IS NOT NULL) AS ai_referral_visits
    FROM ({req_sql()}) q LEFT JOIN {_DIMS_C} ON c.id = q.crawler""",
)
def report_summary(spark, sf_dir):
    return report.summary(report.whole_tally(_parsed(spark, sf_dir)))


_CRAWLER_SQL = f"""SELECT c.id, c.vendor, c.vendor_name, c.token, c.purpose, c.ai_specific, count(*) AS requests, count(DISTINCT path) AS unique_pages, {_ISO.format('max(sec)')} AS last_seen
    FROM {_GOOD} q JOIN {_DIMS_C} ON c.id = q.crawler GROUP BY ALL"""


@query("report_crawlers", _CRAWLER_SQL)
def report_crawlers(spark, sf_dir):
    return report.crawler_rows(_tally(spark, sf_dir))


@query("search_engines", f"SELECT * FROM ({_CRAWLER_SQL}) WHERE NOT ai_specific")
def search_engines(spark, sf_dir):
    return report.crawler_rows(_tally(spark, sf_dir)).where("not ai_specific")


@query(
    "report_referrals",
    f"""SELECT p.id, p.vendor, p.vendor_name, p.product, count(*) AS visits, count(DISTINCT path) AS unique_pages, {_ISO.format('max(sec)')} AS last_seen
    FROM {_GOOD} q JOIN {_DIMS_R} ON p.id = q.product GROUP BY ALL""",
)
def report_referrals(spark, sf_dir):
    return report.referral_rows(_tally(spark, sf_dir))


def _top_sql(col: str, top: int) -> str:
    counts = f"SELECT {col} AS id, path, count(*) AS n FROM {_GOOD} WHERE {col} IS NOT NULL GROUP BY ALL"
    return f"""SELECT id, CAST(rank AS INTEGER) AS rank, path, n FROM
    (SELECT id, path, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, path) AS rank FROM ({counts})) WHERE rank <= {top}"""


@query("report_crawler_top_pages", _top_sql("crawler", 10))
def report_crawler_top_pages(spark, sf_dir):
    return report.top_pages(_tally(spark, sf_dir), "crawler")


@query("report_referral_top_pages", _top_sql("product", 3))
def report_referral_top_pages(spark, sf_dir):
    return report.top_pages(_tally(spark, sf_dir), "referral", 3)


_LABELS = f"""(SELECT path, 'crawler' AS kind, c.token AS label, count(*) AS n FROM {_GOOD} q JOIN {_DIMS_C} ON c.id = q.crawler AND c.ai_specific GROUP BY ALL
    UNION ALL SELECT path, 'referral', p.product, count(*) FROM {_GOOD} q JOIN {_DIMS_R} ON p.id = q.product GROUP BY ALL)"""
_PAGES = f"""SELECT path, CAST(sum(n) FILTER (kind = 'crawler') AS BIGINT) AS crawler_requests, CAST(sum(n) FILTER (kind = 'referral') AS BIGINT) AS referral_visits,
    string_agg(label || ' ' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, label) FILTER (kind = 'crawler') AS crawlers,
    string_agg(label || ' ' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, label) FILTER (kind = 'referral') AS referrals
    FROM {_LABELS} GROUP BY path"""


@query("report_page_labels", f"SELECT path, kind, label, n FROM {_LABELS}")
def report_page_labels(spark, sf_dir):
    return report.page_tally(_tally(spark, sf_dir))


@query(
    "report_pages",
    f"""SELECT path, coalesce(crawler_requests, 0) AS crawler_requests, coalesce(referral_visits, 0) AS referral_visits, coalesce(crawlers, '') AS crawlers, coalesce(referrals, '') AS referrals
    FROM ({_PAGES}) ORDER BY coalesce(crawler_requests, 0) + coalesce(referral_visits, 0) DESC, path LIMIT 10""",
)
def report_pages(spark, sf_dir):
    flat = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit(" "), e["n"].cast("string"))), ",").alias(c)
    return report.page_rows(_tally(spark, sf_dir)).select("path", "crawler_requests", "referral_visits", flat("crawlers"), flat("referrals"))


_SINCE = datetime(2024, 1, 3, 12, tzinfo=timezone.utc)


@query(
    "report_since",
    f"SELECT crawler AS id, count(*) AS requests FROM {_GOOD} WHERE crawler IS NOT NULL AND sec >= TIMESTAMP '2024-01-03 12:00:00' GROUP BY ALL",
)
def report_since(spark, sf_dir):
    return report.crawler_rows(_tally(spark, sf_dir, since=_SINCE)).select("id", "requests")


#: Events whose requests share log files, one for each of the four logs.
_EVENTS_A_FILE = 50_000


def _files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of log files, written by the tasks that render them, for each log a new file every _EVENTS_A_FILE events; it stays for the session.

    log0: combined, CRLF ends, a blank line first; log1: ALB, gzip in two members, padded with zeros; log2: CloudFront, gzip without a name
    for it, that breaks off behind its last whole line; log3: combined again, CR ends, an invalid byte in each line's first field.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        folder = shared_folder(spark)
        req = requests(spark, sf_dir)
        rows = combined_lines(req).where("file in ('log0', 'log3')").unionByName(alb_lines(req).where("file = 'log1'"))
        rows = rows.unionByName(cloudfront_rows(req).where("file = 'log2'").withColumn("line_no", F.col("line_no") - 10)).withColumn("nth", F.floor(F.col("line_no") / _EVENTS_A_FILE))

        def write(name, part):
            body = part.sort_values("line_no")["line"].tolist()
            text = "".join(x + "\n" for x in body)
            if name[0] == "log0":
                data = b" \r\n" + text.replace("\n", "\r\n").encode()
            elif name[0] == "log1":
                cut = text.index("\n", len(text) // 2) + 1
                data = gzip.compress(text[:cut].encode()) + gzip.compress(text[cut:].encode()) + bytes(100)
            elif name[0] == "log2":
                text = f"#Version: 1.0\n#Fields: {_CF_SHORT}\n" + text.replace("\n", "\n#Fields: date time\n", 1)
                tail = "".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(4000))  # an unfinished line that the cut goes through
                press = zlib.compressobj(9, zlib.DEFLATED, 31)
                data = press.compress(text.encode()) + press.flush(zlib.Z_FULL_FLUSH)
                data += (press.compress(tail.encode()) + press.flush())[:-20_000]
            else:
                data = text.replace("\n", "\r").encode().replace(b"203.0.113.", b"\xff.")
            with stores.create(f"{folder}/{name[0]}-{name[1]}") as f:
                f.write(data)
            return pd.DataFrame({"file": [name[0]], "size": [len(data)]})

        rows.groupBy("file", "nth").applyInPandas(write, "file string, size long").write.format("noop").mode("overwrite").save()
        _WRITTEN[key] = folder
    return _WRITTEN[key]


#: The files' names in DuckDB.
_FILE = f"file || '-' || CAST(event_id // {_EVENTS_A_FILE} AS VARCHAR)"


_WRITTEN: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: in spark.checkpoint.dir, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="botledger-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return folder
    path = f"{shared.removeprefix('file://').rstrip('/')}/botledger-logs-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{path}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


@query(
    "read_files",
    f"""SELECT {_FILE} AS file, CASE file WHEN 'log1' THEN 'alb' WHEN 'log2' THEN 'cloudfront' ELSE 'combined' END AS fmt, count(*) + CASE file WHEN 'log0' THEN 1 WHEN 'log2' THEN 3 ELSE 0 END AS lines,
    count(*) FILTER (NOT broken) AS records, count(*) FILTER (broken) + CASE file WHEN 'log2' THEN 1 ELSE 0 END AS skipped, file = 'log2' AS truncated FROM ({req_sql()}) GROUP BY file, event_id // {_EVENTS_A_FILE}""",
)
def read_files(spark, sf_dir):
    """Files as the reader finds them: line ends, blank lines, gzip members, padding, damage, formats."""
    from botledger.plans.engine import Engine

    return Engine(spark).file_stats(_files(spark, sf_dir), lenient=True).withColumn("file", F.substring_index("file", "/", -1))


@query(
    "read_records",
    f"""SELECT {_FILE} AS file, strftime(CASE WHEN file = 'log1' THEN ts ELSE sec END, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, CASE file WHEN 'log2' THEN path || '/café' ELSE path END AS path,
    CAST(status AS INTEGER) AS status, CASE file WHEN 'log1' THEN replace(ua, '"', '''') ELSE ua END AS ua, CASE file WHEN 'log1' THEN '' ELSE referrer END AS referrer FROM {_GOOD}""",
)
def read_records(spark, sf_dir):
    """Records of the files, long plain ones read in ranges."""
    from botledger.plans.engine import Engine

    found = lines.records(Engine(spark).parse(_files(spark, sf_dir), split=True, splitBytes=100_000, lenient=True))
    return found.select(F.substring_index("file", "/", -1).alias("file"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"), "path", "status", "ua", "referrer")


_READ = f"""(SELECT CASE file WHEN 'log2' THEN path || '/café' ELSE path END AS path, crawler, CASE WHEN crawler IS NULL AND file <> 'log1' THEN any_product END AS product,
    date_trunc('second', ts) AS sec FROM {_GOOD})"""


#: The files that break off; each has a useless header.
_CUT = f"(SELECT DISTINCT {_FILE} AS file FROM ({req_sql()}) WHERE file = 'log2')"


@query(
    "read_report",
    f"""SELECT 'crawler' AS kind, crawler AS id, count(*) AS n, count(DISTINCT path) AS unique_pages, {_ISO.format('max(sec)')} AS last_seen FROM {_READ} WHERE crawler IS NOT NULL GROUP BY crawler
    UNION ALL SELECT 'referral', product, count(*), count(DISTINCT path), {_ISO.format('max(sec)')} FROM {_READ} WHERE product IS NOT NULL GROUP BY product
    UNION ALL SELECT 'records', 'all', count(*) FILTER (NOT broken), 0, '' FROM ({req_sql()}) UNION ALL SELECT 'skipped', 'all', count(*) FILTER (broken) + (SELECT count(*) FROM {_CUT}), 0, '' FROM ({req_sql()})
    UNION ALL SELECT 'damaged', file, 1, 0, '' FROM {_CUT}""",
)
def read_report(spark, sf_dir):
    """The report over files of all formats, from the one pass that reads them."""
    from botledger.plans.engine import Engine

    parsed = lines.parse_source(Engine(spark).lines(_files(spark, sf_dir), split=True, lenient=True))
    return _report_rows(report.report_of(_written(report.whole_tally(parsed))))


def _report_rows(rep: report.Report) -> DataFrame:
    row = lambda df, kind, key, n, pages=F.lit(0), seen=F.lit(""): df.select(
        F.lit(kind).alias("kind"), key.alias("id"), n.cast("long").alias("n"), pages.cast("long").alias("unique_pages"), seen.alias("last_seen")
    )
    parts = [
        row(rep.crawlers, "crawler", F.col("id"), F.col("requests"), F.col("unique_pages"), F.col("last_seen")),
        row(rep.referrals, "referral", F.col("id"), F.col("visits"), F.col("unique_pages"), F.col("last_seen")),
        row(rep.summary, "records", F.lit("all"), F.col("records")),
        row(rep.summary, "skipped", F.lit("all"), F.col("skipped")),
        row(rep.files.where("damaged"), "damaged", F.substring_index("file", "/", -1), F.lit(1)),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def _written(t: DataFrame) -> DataFrame:
    """A tally as a table in the shared folder, for queries that read it more than once."""
    path = f"{shared_folder(t.sparkSession)}/tally"
    t.write.parquet(path)
    return t.sparkSession.read.schema(t.schema).parquet(path)


@query(
    "stream_report",
    f"""SELECT 'crawler' AS kind, crawler AS id, count(*) AS n, count(DISTINCT path) AS unique_pages, {_ISO.format('max(sec)')} AS last_seen FROM {_GOOD} WHERE crawler IS NOT NULL GROUP BY crawler
    UNION ALL SELECT 'referral', product, count(*), count(DISTINCT path), {_ISO.format('max(sec)')} FROM {_GOOD} WHERE product IS NOT NULL GROUP BY product
    UNION ALL SELECT 'records', 'all', count(*) FILTER (NOT broken), 0, '' FROM ({req_sql()}) UNION ALL SELECT 'skipped', 'all', count(*) FILTER (broken), 0, '' FROM ({req_sql()})""",
)
def stream_report(spark, sf_dir):
    """The running report over log files that a stream takes from a folder, plain and gzip, a few a batch, until there are no more."""
    from botledger.streaming import live

    folder = shared_folder(spark)
    req = combined_lines(requests(spark, sf_dir))
    for k in range(4):  # a writer for each log; their files mix in one folder
        own = req.where(F.col("file") == f"log{k}").select("line")
        own.write.mode("append").option("compression", "gzip" if k % 2 else "none").text(f"{folder}/in")
    parsed = live.log_stream(spark, f"{folder}/in", ledger=f"{folder}/arrivals", max_files=32, lenient=True)
    q = live.start_report(parsed, lambda _: None, checkpoint=f"{folder}/state", partitions=live.state_partitions(spark))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return _report_rows(live.report_of_snapshot(live.latest_snapshot(spark, f"{folder}/state/report")))


#: Events whose lines are pasted as one text.
_PASTED = 500


@query(
    "pasted_text",
    f"""SELECT file, nth AS line_no, CASE WHEN blank THEN 'blank' WHEN broken THEN 'malformed' ELSE 'record' END AS outcome, CASE WHEN NOT blank AND NOT broken THEN path END AS path, CASE WHEN NOT blank AND NOT broken THEN CAST(status AS INTEGER) END AS status
    FROM (SELECT *, event_id % 19 = 7 AS blank, row_number() OVER (PARTITION BY file ORDER BY event_id) AS nth FROM (SELECT * REPLACE (CAST(event_id // {_PASTED} AS VARCHAR) AS file) FROM ({req_sql()})))""",
)
def pasted_text(spark, sf_dir):
    """Texts of some hundred log lines each, blank ones among them, with breaks of all kinds."""
    req = combined_lines(requests(spark, sf_dir)).withColumn("file", F.floor(F.col("line_no") / _PASTED).cast("string"))
    line = F.when(F.col("line_no") % 19 == 7, F.lit("  ")).otherwise(F.col("line"))
    ends = F.element_at(F.array(F.lit("\r"), F.lit("\r\n"), F.lit("\n")), (F.col("line_no") % 3 + 1).cast("int"))
    texts = req.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat(line, ends).alias("l")))), lambda x: x["l"]), "").alias("text"))
    return lines.parse_lines(logfiles.lines_of_texts(texts, lenient=True)).select("file", "line_no", "outcome", "path", "status")


@query("file_stats", f"SELECT file, count(*) AS lines, count(*) FILTER (NOT broken) AS records, count(*) FILTER (broken) AS skipped FROM ({req_sql()}) GROUP BY file")
def file_stats(spark, sf_dir):
    return lines.file_stats(_parsed(spark, sf_dir))


@query(
    "mixed_formats",
    f"""SELECT file, count(*) AS lines, count(*) FILTER (NOT broken) AS records, count(*) FILTER (broken) AS skipped, CASE file WHEN 'log0' THEN 'combined' WHEN 'log3' THEN 'cloudfront' ELSE 'alb' END AS fmt
    FROM ({req_sql()}) GROUP BY file""",
)
def mixed_formats(spark, sf_dir):
    """Files of three formats read as one: each file's format from its own first line."""
    from botledger.sources.logfiles import with_format

    req = requests(spark, sf_dir)
    rows = combined_lines(req).where("file = 'log0'").unionByName(alb_lines(req).where("file in ('log1', 'log2')")).unionByName(cloudfront_lines(req).where("file = 'log3'"))
    tagged = with_format(rows, lenient=True)
    return lines.file_stats(lines.parse_lines(tagged)).join(tagged.groupBy("file").agg(F.first("fmt").alias("fmt")), "file")


@query(
    "report_json",
    f"""SELECT crawler AS id, count(*) AS requests, (SELECT string_agg(path || ' ' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, path)
      FROM (SELECT path, count(*) AS n FROM {_GOOD} WHERE crawler = q.crawler GROUP BY path ORDER BY n DESC, path LIMIT 2)) AS top_pages FROM {_GOOD} q WHERE crawler IS NOT NULL GROUP BY crawler""",
)
def report_json(spark, sf_dir):
    """Crawler rows of the JSON report (its few rows pass through the driver, as the report does)."""
    data = report.report_of(_written(report.whole_tally(_parsed(spark, sf_dir))), top=2).to_dict()
    rows = [(r["id"], r["requests"], ",".join(f"{p['path']} {p['count']}" for p in r["top_pages"])) for r in data["crawlers"]]
    return spark.createDataFrame(rows, "id string, requests long, top_pages string")


@query(
    "page_view",
    f"""SELECT q.crawler AS id, count(*) AS requests, strftime(max(sec), '%Y-%m-%d %H:%M') AS seen, (SELECT string_agg(path, chr(10) ORDER BY n DESC, path)
      FROM (SELECT path, count(*) AS n FROM {_GOOD} WHERE crawler = q.crawler GROUP BY path ORDER BY n DESC, path LIMIT 3)) AS pages
      FROM {_GOOD} q JOIN {_DIMS_C} ON c.id = q.crawler AND c.ai_specific GROUP BY q.crawler""",
)
def page_view(spark, sf_dir):
    from botledger.plans.engine import page_view as view

    return view(report.report_of(_written(report.whole_tally(_parsed(spark, sf_dir)))))["crawlers"].select("id", "requests", "seen", "pages")


@query(
    "vendor_catalogue",
    f"""SELECT vendor, vendor_name, count(*) AS crawlers, string_agg(token, ',' ORDER BY o) AS tokens, count(*) FILTER (d) AS documented, CAST(coalesce(sum(n), 0) AS BIGINT) AS requests
    FROM {values([(c[0], c[1], c[2], c[3], c[4], c[8]) for c in catalogue.CRAWLERS], 'o, id, vendor, vendor_name, token, d')} LEFT JOIN (SELECT crawler, count(*) AS n FROM {_GOOD} GROUP BY crawler) ON crawler = id GROUP BY vendor, vendor_name""",
)
def vendor_catalogue(spark, sf_dir):
    """Each vendor's crawlers, and what they asked for, if anything."""
    asked = report.crawler_rows(_tally(spark, sf_dir)).select("id", "requests")
    return catalogue.crawlers(spark).join(asked, "id", "left").groupBy("vendor", "vendor_name").agg(
        F.count(F.lit(1)).alias("crawlers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"]), ",").alias("tokens"),
        F.count_if(F.col("vendor_documented")).alias("documented"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
    )


@query(
    "catalogue_counts",
    f"""SELECT CAST(28 AS BIGINT) AS crawlers, CAST(13 AS BIGINT) AS vendors, CAST(27 AS BIGINT) AS documented, CAST(12 AS BIGINT) AS chats,
    count(DISTINCT crawler) AS crawlers_seen, count(DISTINCT product) AS chats_seen FROM {_GOOD}""",
)
def catalogue_counts(spark, sf_dir):
    """The catalogue's headline numbers, and how much of it the log shows."""
    seen = _tally(spark, sf_dir).select("kind", "id").distinct().agg(F.count_if(F.col("kind") == "crawler").alias("crawlers_seen"), F.count_if(F.col("kind") == "referral").alias("chats_seen"))
    return catalogue.counts(spark).crossJoin(seen)  # one row each


@query(
    "coverage_gaps",
    f"""WITH seen AS (SELECT DISTINCT path, 'crawler' AS kind, crawler AS id FROM {_GOOD} WHERE crawler IS NOT NULL UNION ALL SELECT DISTINCT path, 'referral', product FROM {_GOOD} WHERE product IS NOT NULL)
    SELECT path, kind, id FROM (SELECT DISTINCT path FROM seen), {values([("crawler", c[1]) for c in catalogue.CRAWLERS if not c[7]] + [("referral", r[1]) for r in catalogue.REFERRERS], 'kind, id')} EXCEPT SELECT path, kind, id FROM seen""",
)
def coverage_gaps(spark, sf_dir):
    """Which of the catalogue did not come to each page."""
    return report.coverage_gaps(_tally(spark, sf_dir))


_LISTED = [(r[1], h) for r in catalogue.REFERRERS for h in r[5]]


@query(
    "catalogue_hosts",
    f"""SELECT a AS id, b AS host, CAST(length(b) - length(replace(b, '.', '')) + 1 AS INTEGER) AS labels, coalesce(n, 0) AS visits
    FROM {values(_LISTED, 'a, b')} LEFT JOIN (SELECT product, count(*) AS n FROM {_GOOD} GROUP BY product) ON product = a""",
)
def catalogue_hosts(spark, sf_dir):
    """Each product's hosts, with the visits that it brought."""
    rows = catalogue.referrers(spark).select("id", F.explode("hosts").alias("host")).join(report.referral_rows(_tally(spark, sf_dir)).select("id", "visits"), "id", "left")
    return rows.select("id", "host", F.size(F.split("host", "[.]")).alias("labels"), F.coalesce("visits", F.lit(0)).alias("visits"))


@query(
    "log_totals",
    f"""SELECT CAST(count(*) FILTER (c.ai_specific) AS BIGINT) AS ai_requests, count(DISTINCT crawler) FILTER (c.ai_specific) AS ai_crawlers, count(*) FILTER (product IS NOT NULL) AS ai_visits
    FROM {_GOOD} q LEFT JOIN {_DIMS_C} ON c.id = q.crawler""",
)
def log_totals(spark, sf_dir):
    t_ = _tally(spark, sf_dir)
    ai = report.crawler_rows(t_).where("ai_specific").agg(F.sum("requests").alias("ai_requests"), F.count(F.lit(1)).alias("ai_crawlers"))
    return ai.crossJoin(report.referral_rows(t_).agg(F.sum("visits").alias("ai_visits")))  # one row each


# ------------------------------------------------------------------ robots

#: Pages with their site (a host's 500 pages next to each other), path, and a line of the site's robots.txt that it brings in, in SQL that both engines read.
_SITE_PAGES = """
SELECT *, CASE page_id % 9 WHEN 0 THEN 'Disallow: ' || path WHEN 1 THEN 'Allow: ' || path WHEN 2 THEN 'disallow : /' || seg || '/' WHEN 3 THEN 'Disallow: /*' || right(path, 2) || '$ # by sign'
    WHEN 4 THEN 'Allow: /' || seg || '/*/' WHEN 5 THEN 'User-agent: ' || CASE page_id % 7 WHEN 0 THEN 'GPTBot' WHEN 1 THEN 'ClaudeBot' WHEN 2 THEN '*' WHEN 3 THEN 'bingbot/2.0' WHEN 4 THEN 'CCBot' WHEN 5 THEN 'NoSuchBot' ELSE 'perplexitybot' END
    WHEN 6 THEN 'Disallow: ' || path || '$' WHEN 7 THEN 'Disallow:' ELSE CASE WHEN page_id % 5 = 0 THEN 'Disallow: /' ELSE 'Allow: /' || seg END END AS line
FROM (SELECT page_id, host || ':' || CAST(CAST(floor(page_id / 500) AS BIGINT) AS STRING) AS doc, path, regexp_extract(path, '^/([^/]*)', 1) AS seg
  FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, CASE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END AS path FROM pages_))
"""
_SITE_HEAD = "CASE WHEN min(page_id) % 4 = 0 THEN 'User-agent: GPTBot' ELSE 'User-agent: *' END"
_SITE_PAGES_SQL = f"({_SITE_PAGES.replace('pages_', 'pages')})"
#: One site in eleven has no file.
_ROBOTS_CTE = f"""rf AS MATERIALIZED (SELECT doc, CASE WHEN min(page_id) % 11 <> 3 THEN {_SITE_HEAD} || chr(10) || string_agg(line, chr(10) ORDER BY page_id, line) END AS text FROM {_SITE_PAGES_SQL} GROUP BY doc)"""
_ROBOTS_SQL = "rf AS d"
#: Lines, groups and rules in DuckDB. Texts have no odd white space, so trim() will do.
_GROUPS_SQL = rf"""{_ROBOTS_CTE},
raw AS (SELECT doc, regexp_split_to_array(text, '\r\n|\r|\n') AS parts FROM {_ROBOTS_SQL} WHERE text IS NOT NULL),
ln AS (SELECT doc, generate_subscripts(parts, 1) AS line, unnest(parts) AS raw FROM raw),
kv AS (SELECT doc, line, trim(raw) AS text, lower(trim(split_part(split_part(raw, '#', 1), ':', 1))) AS key, trim(substr(split_part(raw, '#', 1), strpos(split_part(raw, '#', 1), ':') + 1)) AS value
  FROM ln WHERE strpos(split_part(raw, '#', 1), ':') > 0),
k3 AS (SELECT *, coalesce(lag(key) OVER (PARTITION BY doc ORDER BY line), 'allow') AS prev FROM kv WHERE key IN ('user-agent', 'allow', 'disallow')),
gr AS (SELECT doc, CAST(sum(CASE WHEN key = 'user-agent' AND prev <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line) AS INTEGER) AS grp, line, text, key, value,
  CASE WHEN key = 'user-agent' THEN CASE WHEN value LIKE '*%' THEN '*' ELSE lower(regexp_extract(value, '^[A-Za-z_-]+')) END END AS product FROM k3),
g AS (SELECT * FROM gr WHERE grp > 0)"""
_LIKE = "{1} LIKE replace(replace(replace(CASE WHEN {0} LIKE '%$' THEN left({0}, length({0}) - 1) ELSE {0} END, '%', '\\%'), '_', '\\_'), '*', '%') || CASE WHEN {0} LIKE '%$' THEN '' ELSE '%' END ESCAPE '\\'"
_VERDICT_SQL = f"""
cr AS (SELECT * FROM {values([c[:8] for c in catalogue.CRAWLERS], 'ord, id, vendor, vendor_name, token, purpose, ai_specific, robots_only')}),
use AS (SELECT d.doc, cr.*, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.doc = d.doc AND g.product = lower(token)) THEN 'token' WHEN EXISTS (SELECT 1 FROM g WHERE g.doc = d.doc AND g.product = '*') THEN 'star' ELSE 'none' END AS source
  FROM {_ROBOTS_SQL}, cr),
keyed AS (SELECT *, CASE source WHEN 'token' THEN lower(token) WHEN 'star' THEN '*' END AS product FROM use),
sets AS (SELECT DISTINCT doc, product, grp FROM g WHERE product IS NOT NULL),
rules AS (SELECT s.doc, s.product, g.line, g.text, g.key = 'allow' AS allow, g.value AS pat FROM sets s JOIN g ON g.doc = s.doc AND g.grp = s.grp WHERE g.key <> 'user-agent' AND g.value <> ''),
root AS (SELECT doc, product, arg_max(struct_pack(allow := allow, line := line, text := text), struct_pack(a := length(pat), b := allow, c := -line)) AS r FROM rules WHERE {_LIKE.format('pat', "'/'")} GROUP BY doc, product),
pr AS (SELECT doc, product, line, text, pat, unnest(CASE WHEN pat LIKE '%$' THEN [p] ELSE [p, p || CASE WHEN p LIKE '%/' THEN '' ELSE '/' END || '{rulesets.PROBE}'] END) AS path FROM
  (SELECT *, CASE WHEN q LIKE '/%' THEN q ELSE '/' || q END AS p FROM (SELECT *, regexp_replace(replace(pat, '*', ''), '\\$$', '') AS q FROM rules WHERE NOT allow))),
best AS (SELECT pr.*, (SELECT max(length(a.pat)) FROM rules a WHERE a.doc = pr.doc AND a.product = pr.product AND a.allow AND length(a.pat) >= length(pr.pat) AND {_LIKE.format('a.pat', 'pr.path')}) AS b FROM pr WHERE {_LIKE.format('pr.pat', 'pr.path')}),
still AS (SELECT DISTINCT doc, product, line, text FROM best WHERE b IS NULL OR EXISTS (SELECT 1 FROM rules o WHERE o.doc = best.doc AND o.product = best.product AND NOT o.allow AND length(o.pat) > best.b AND {_LIKE.format('o.pat', 'best.path')})),
judged AS (SELECT k.doc, k.ord, k.id, k.vendor, k.vendor_name, k.token, k.purpose, k.source, k.product, CASE WHEN NOT coalesce(r.r.allow, TRUE) THEN 'blocked' WHEN EXISTS (SELECT 1 FROM still s WHERE s.doc = k.doc AND s.product = k.product) THEN 'partial' ELSE 'allowed' END AS verdict, r.r AS root
  FROM keyed k LEFT JOIN root r ON r.doc = k.doc AND r.product = k.product),
ev AS (SELECT DISTINCT j.doc, j.ord, x.line, x.text FROM judged j, LATERAL (
  SELECT g.line, g.text FROM (SELECT *, row_number() OVER (PARTITION BY doc, product ORDER BY line) AS k FROM g) g WHERE g.doc = j.doc AND g.product = j.product AND k <= {rulesets.MAX_EVIDENCE}
  UNION ALL SELECT s.line, s.text FROM (SELECT *, row_number() OVER (PARTITION BY doc, product ORDER BY line) AS k FROM still) s WHERE s.doc = j.doc AND s.product = j.product AND j.verdict = 'partial' AND k <= {rulesets.MAX_EVIDENCE}
  UNION ALL SELECT j.root.line, j.root.text WHERE j.verdict <> 'partial' AND j.root IS NOT NULL) x)"""
_ROBOTS_WITH = f"WITH {_GROUPS_SQL}, {_VERDICT_SQL}"


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SITE_PAGES.replace("pages_", "{pages}"), pages=table(spark, sf_dir, "pages"))


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text): the sites' robots.txt files, made of their pages."""
    by_page = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "line"))), lambda x: x["line"])  # 500 pages at most
    made = _site_pages(spark, sf_dir).groupBy("doc").agg(F.expr(_SITE_HEAD).alias("head"), by_page.alias("lines"), F.min("page_id").alias("first"))
    text = F.concat("head", F.lit("\n"), F.array_join("lines", "\n"))
    return made.select("doc", F.when(F.col("first") % 11 != 3, text).alias("text"))


@query("robots_groups", f"WITH {_GROUPS_SQL} SELECT doc, grp, CAST(line AS INTEGER) AS line, text, key, value, product FROM g")
def robots_groups(spark, sf_dir):
    return robots.parse(_robots(spark, sf_dir).where("text is not null"))


@query(
    "robots_pattern_match",
    f"""WITH {_GROUPS_SQL} SELECT DISTINCT p.doc, g.value AS pattern, p.path, {_LIKE.format('g.value', 'p.path')} AS matches
    FROM {_SITE_PAGES_SQL} p JOIN g ON g.doc = p.doc AND g.key <> 'user-agent'""",
)
def robots_pattern_match(spark, sf_dir):
    """Each rule of a site's file on each of the site's own pages."""
    rules = robots.parse(_robots(spark, sf_dir).where("text is not null")).where("key <> 'user-agent'").select("doc", F.col("value").alias("pattern")).distinct()
    return rules.join(_site_pages(spark, sf_dir).select("doc", "path").distinct(), "doc").select(
        "doc", "pattern", "path", rulesets.pattern_matches(F.col("pattern"), F.col("path")).alias("matches")
    )


@query(
    "robots_decide",
    f"""WITH {_GROUPS_SQL}, p AS (SELECT DISTINCT doc, path FROM {_SITE_PAGES_SQL}),
    hit AS (SELECT p.doc, p.path, arg_max(struct_pack(a := g.key = 'allow', l := line), struct_pack(x := length(value), y := g.key = 'allow', z := -line)) AS b
      FROM p JOIN g ON g.doc = p.doc AND g.key <> 'user-agent' AND value <> '' AND {_LIKE.format('value', 'p.path')} GROUP BY p.doc, p.path)
    SELECT p.doc AS "case", p.path, coalesce(b.a, TRUE) AS allowed, CAST(b.l AS INTEGER) AS line FROM p LEFT JOIN hit ON hit.doc = p.doc AND hit.path = p.path""",
)
def robots_decide(spark, sf_dir):
    rules = robots.parse(_robots(spark, sf_dir).where("text is not null")).where("key <> 'user-agent'")
    own = rules.select(F.col("doc").alias("case"), "line", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return robots.decide(own, _site_pages(spark, sf_dir).select(F.col("doc").alias("case"), "path"))


@query(
    "robots_page_access",
    f"""{_ROBOTS_WITH}, p AS (SELECT DISTINCT doc, path FROM {_SITE_PAGES_SQL}),
    hit AS (SELECT p.doc, p.path, r.product, arg_max(struct_pack(a := allow, l := line), struct_pack(x := length(pat), y := allow, z := -line)) AS b
      FROM p JOIN rules r ON r.doc = p.doc AND {_LIKE.format('pat', 'p.path')} GROUP BY p.doc, p.path, r.product)
    SELECT p.doc, p.path, k.id, k.source, coalesce(b.a, TRUE) AS allowed, CAST(b.l AS INTEGER) AS line
    FROM p JOIN keyed k ON k.doc = p.doc LEFT JOIN hit ON hit.doc = p.doc AND hit.path = p.path AND hit.product = k.product""",
)
def robots_page_access(spark, sf_dir):
    """Rules by pages as a join: each crawler on each page of each site."""
    return robots.page_access(_robots(spark, sf_dir), _site_pages(spark, sf_dir))


@query("robots_verdicts", f"{_ROBOTS_WITH} SELECT doc, CAST(ord AS INTEGER) AS ord, id, token, source, verdict FROM judged")
def robots_verdicts(spark, sf_dir):
    return robots.verdicts(_robots(spark, sf_dir)).select("doc", "ord", "id", "token", "source", "verdict")


@query("robots_evidence", f"{_ROBOTS_WITH} SELECT doc, CAST(ord AS INTEGER) AS ord, CAST(line AS INTEGER) AS line, text FROM ev")
def robots_evidence(spark, sf_dir):
    return robots.verdicts(_robots(spark, sf_dir)).select("doc", "ord", F.explode("lines").alias("e")).select("doc", "ord", "e.line", "e.text")


@query(
    "robots_counts",
    f"""{_ROBOTS_WITH} SELECT doc, count(*) AS total, count(*) FILTER (verdict = 'allowed') AS allowed, count(*) FILTER (verdict = 'blocked') AS blocked,
    count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (source = 'token') AS named FROM judged GROUP BY doc""",
)
def robots_counts(spark, sf_dir):
    return robots.verdict_counts(robots.verdicts(_robots(spark, sf_dir)))


@query(
    "robots_headline",
    f"""{_ROBOTS_WITH} SELECT *, CASE WHEN blocked_everywhere > 0 THEN CASE WHEN blocked_some > 0 THEN 'both' ELSE 'everywhere' END WHEN blocked_some > 0 THEN 'some' ELSE 'none' END AS parts
    FROM (SELECT doc, count(*) FILTER (verdict = 'allowed') AS allowed, count(*) AS total, count(*) FILTER (verdict = 'blocked') AS blocked_everywhere, count(*) FILTER (verdict = 'partial') AS blocked_some FROM judged GROUP BY doc)""",
)
def robots_headline(spark, sf_dir):
    return robots.headline(robots.verdicts(_robots(spark, sf_dir)))


_SUMMARY_SQL = "SELECT doc, vendor, vendor_name, purpose, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) ELSE 'mixed' END AS verdict, min(ord) AS ord FROM judged GROUP BY ALL"


@query("robots_vendor_summary", f"{_ROBOTS_WITH} SELECT doc, vendor, vendor_name, purpose, verdict FROM ({_SUMMARY_SQL})")
def robots_vendor_summary(spark, sf_dir):
    return robots.vendor_summary(robots.verdicts(_robots(spark, sf_dir))).select("doc", "vendor", "vendor_name", F.explode("purposes").alias("purpose", "verdict"))


@query(
    "robots_purpose_groups",
    f"""{_ROBOTS_WITH} SELECT j.doc, j.purpose, CAST(row_number() OVER (PARTITION BY j.doc, j.purpose ORDER BY CASE j.verdict WHEN 'blocked' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, j.ord) AS INTEGER) AS rank,
    j.token, j.verdict, (SELECT string_agg(text, '  ' ORDER BY line) FROM ev WHERE ev.doc = j.doc AND ev.ord = j.ord) AS evidence FROM judged j""",
)
def robots_purpose_groups(spark, sf_dir):
    g = robots.purpose_groups(robots.verdicts(_robots(spark, sf_dir)))
    return g.select("doc", "purpose", F.posexplode("rows").alias("at", "r")).select("doc", "purpose", (F.col("at") + 1).alias("rank"), "r.token", "r.verdict", "r.evidence")


_NAMES = "coalesce(string_agg(vendor_name, ',' ORDER BY ord) FILTER (verdict IN ({})), '')"


@query(
    "robots_vendor_buckets",
    f"""{_ROBOTS_WITH} SELECT *, CASE WHEN blocked = '' AND "some" = '' THEN 'all' WHEN allowed = '' AND "some" = '' THEN 'none' ELSE 'mixed' END AS kind FROM (
    SELECT doc, purpose, {_NAMES.format("'blocked'")} AS blocked, {_NAMES.format("'partial', 'mixed'")} AS "some", {_NAMES.format("'allowed'")} AS allowed
    FROM (SELECT doc, vendor, vendor_name, purpose, verdict, min(ord) OVER (PARTITION BY doc, vendor) AS ord FROM ({_SUMMARY_SQL})) GROUP BY doc, purpose)""",
)
def robots_vendor_buckets(spark, sf_dir):
    b = robots.vendor_buckets(robots.verdicts(_robots(spark, sf_dir)))
    return b.select("doc", "purpose", *[F.array_join(c, ",").alias(c) for c in ("blocked", "some", "allowed")], "kind")


@query(
    "robots_next_crawler",
    f"""{_ROBOTS_WITH} SELECT d.doc, CASE WHEN d.text IS NULL THEN 'none' WHEN NOT EXISTS (SELECT 1 FROM g WHERE g.doc = d.doc AND g.product = '*') THEN 'open'
    WHEN coalesce((SELECT arg_min(verdict, ord) FROM judged j WHERE j.doc = d.doc AND j.source = 'star'), 'blocked') = 'blocked' THEN 'closed' ELSE 'open' END AS outlook FROM {_ROBOTS_SQL}""",
)
def robots_next_crawler(spark, sf_dir):
    docs = _robots(spark, sf_dir)
    return robots.next_crawler(docs, robots.verdicts(docs))


# ------------------------------------------------------------------ site files

_LLMS = [
    ("# Site\n> hello\n- [a](https://x/a): one\n- [b](https://x/b)", "Site", 2), ("no heading [x](y) [z]( q) [w]()", None, 1), ("# \n# Second\n[a]\n(b)", None, 0), ("## no\n#no\n# Yes  \n[[a](b)[c](d)", "Yes", 2),
    ("[" * 3000 + "](x)", None, 1), ("", None, 0), ("[a](b c) [d](e)\r\n# T", "T", 1),
]


@query(
    "llms_summary",
    f"""SELECT doc_id, NULL AS title, CAST(len(regexp_extract_all(text, '\\[[^\\]\\n]*\\]\\([^)\\s]+\\)')) AS BIGINT) AS links FROM documents
    UNION ALL SELECT * FROM {values([(-1 - i, a, b) for i, (_, a, b) in enumerate(_LLMS)], 'doc_id, title, links')}""",
)
def llms_summary(spark, sf_dir):
    made = spark.createDataFrame([(-1 - i, x[0]) for i, x in enumerate(_LLMS)], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(made)
    return docs.select("doc_id", sitefiles.llms_title(F.col("text")).alias("title"), sitefiles.llms_links(F.col("text")).alias("links"))


@query("document_lines", "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS BIGINT) AS lines FROM documents")
def document_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sitefiles.count_lines(F.col("text")).alias("lines"))


@query("html_sniff", r"SELECT 'page' AS kind, page_id AS id, regexp_matches(lower(left(html, 256)), '^\s*(<!doctype html|<html|<head|<body)') AS html FROM pages UNION ALL SELECT 'doc', doc_id, FALSE FROM documents "
    "UNION ALL SELECT 'made', * FROM " + values([(0, True), (1, True), (2, False), (3, False)], "a, b"))
def html_sniff(spark, sf_dir):
    made = spark.createDataFrame([(0, "﻿ \n<!DOCTYPE HTML>"), (1, "<HeAd>"), (2, " " * 256 + "<html"), (3, "User-agent: *")], "id long, text string").select(F.lit("made").alias("kind"), "id", "text")
    rows = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    rows = rows.unionByName(table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")).unionByName(made)
    return rows.select("kind", "id", sitefiles.looks_like_html(F.col("text")).alias("html"))


#: What fetching a site's file gave, by page: a status or none, and a text: the page, its address, or none.
_FETCHED = """SELECT page_id AS id, CAST(CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 403 WHEN 3 THEN 500 WHEN 4 THEN NULL WHEN 5 THEN 302 WHEN 6 THEN 204 ELSE 200 END AS INT) AS status,
    CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN url END AS text FROM pages_"""


@query(
    "status_outcome",
    f"""SELECT id, outcome, CASE outcome WHEN 'found' THEN 'ok' WHEN 'missing' THEN 'none' WHEN 'html' THEN 'none' ELSE 'warn' END AS mark,
    CASE WHEN outcome IN ('found', 'html') THEN outcome WHEN outcome = 'missing' THEN CASE WHEN status = 403 THEN 'unavailable' ELSE 'missing' END END AS robots_line
    FROM (SELECT *, CASE WHEN status IS NULL OR status = 302 THEN 'unreachable' WHEN status = 500 THEN 'server-error' WHEN status >= 400 THEN 'missing' WHEN text IS NULL THEN 'unreachable'
      WHEN regexp_matches(lower(left(text, 256)), '^\\s*(<!doctype html|<html|<head|<body)') THEN 'html' ELSE 'found' END AS outcome FROM ({_FETCHED.replace('pages_', 'pages')}))""",
)
def status_outcome(spark, sf_dir):
    df = spark.sql(_FETCHED.replace("pages_", "{pages}"), pages=table(spark, sf_dir, "pages")).withColumn("outcome", sitefiles.file_outcome(F.col("status"), F.col("text")))
    return df.select("id", "outcome", sitefiles.file_mark(F.col("outcome")).alias("mark"), sitefiles.robots_line_kind(F.col("outcome"), F.col("status")).alias("robots_line"))


#: llms.txt files by document: half of them with a title, one in five of these an empty one.
_LLMS_FILES = """SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'pasted' WHEN 1 THEN 'missing' WHEN 2 THEN 'html' WHEN 3 THEN 'unreachable' WHEN 4 THEN 'server-error' ELSE 'found' END AS outcome,
    CASE WHEN doc_id % 2 = 0 THEN concat('# ', CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE CAST(doc_id AS STRING) END, chr(10)) ELSE '' END || text AS text FROM documents_"""


@query(
    "llms_line",
    f"""SELECT id, title, CASE WHEN outcome IN ('unreachable', 'pasted') THEN outcome WHEN outcome = 'found' THEN CASE WHEN title IS NULL THEN 'found_untitled' ELSE 'found' END ELSE 'missing' END AS kind
    FROM (SELECT *, nullif(trim(substr(list_filter(string_split(left(text, 512000), chr(10)), lambda x: x LIKE '# %')[1], 3)), '') AS title FROM ({_LLMS_FILES.replace('documents_', 'documents')}))""",
)
def llms_line(spark, sf_dir):
    df = spark.sql(_LLMS_FILES.replace("documents_", "{documents}"), documents=table(spark, sf_dir, "documents")).withColumn("title", sitefiles.llms_title(F.col("text")))
    return df.select("id", "title", sitefiles.llms_line_kind(F.col("outcome"), F.col("title")).alias("kind"))


# ------------------------------------------------------------------ sessions


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = requests(spark, sf_dir)
    nav = F.when(F.col("event_id") % 5 == 0, "reload").when(F.col("event_id") % 7 == 0, "back_forward").otherwise("navigate")
    return req.select(F.col("user_id").cast("string").alias("session_id"), "ts", F.col("event_id").alias("seq"), "referrer", F.lit("www.meta.ai").alias("hostname"), nav.alias("nav_type"))


_VIEWS = f"""(SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id AS seq, CASE WHEN any_product <> 'meta-ai' THEN any_product END AS own,
    event_id % 5 <> 0 AND event_id % 7 <> 0 AS fresh FROM ({req_sql()}))"""
_ATTRIBUTED = f"""SELECT session_id, seq, source, p.vendor, CASE WHEN source IS NOT NULL THEN own IS NOT NULL AND fresh END AS landing FROM
    (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS source FROM {_VIEWS}) a LEFT JOIN {_DIMS_R} ON p.id = a.source"""


@query("session_attribution", _ATTRIBUTED)
def session_attribution(spark, sf_dir):
    return sessions.attribute(views(spark, sf_dir)).select("session_id", "seq", "source", "vendor", "landing")


@query("session_landings", f"SELECT source, count(*) AS landings, count(DISTINCT session_id) AS sessions FROM ({_ATTRIBUTED}) WHERE landing GROUP BY source")
def session_landings(spark, sf_dir):
    won = sessions.landings(sessions.attribute(views(spark, sf_dir)))
    return won.groupBy("source").agg(F.count(F.lit(1)).alias("landings"), F.countDistinct("session_id").alias("sessions"))


#: Minutes without a view that end a session, in the stream and its counterparts.
_IDLE = 120
_VISITS = f"""(SELECT *, sum(gap) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visit FROM
    (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq) + INTERVAL {_IDLE} MINUTE THEN 1 ELSE 0 END AS gap FROM {_VIEWS}))"""
_ENDING = f"""SELECT session_id, seq, source, p.vendor, CASE WHEN source IS NOT NULL THEN own IS NOT NULL AND fresh END AS landing FROM
    (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY session_id, visit ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS source FROM {_VISITS}) a LEFT JOIN {_DIMS_R} ON p.id = a.source"""


@query("session_visits", _ENDING)
def session_visits(spark, sf_dir):
    """Sessions that end when idle."""
    return sessions.attribute(views(spark, sf_dir), _IDLE).select("session_id", "seq", "source", "vendor", "landing")


@query("stream_sessions", _ENDING)
def stream_sessions(spark, sf_dir):
    """The same from a stream whose files hold views out of order."""
    from botledger.streaming import live

    folder = shared_folder(spark)
    seen = views(spark, sf_dir)
    day = F.to_date("ts")
    files = seen.repartitionByRange(max(4, 2 * spark.sparkContext.defaultParallelism), day, "seq").sortWithinPartitions(day, F.xxhash64("seq"))  # within a file in any order
    files.write.parquet(f"{folder}/in")
    last = seen.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("session_id"), (F.col("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"), *[F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in seen.columns[2:]])
    last.select(*seen.columns).write.mode("append").parquet(f"{folder}/in")  # time goes on: what waits comes out
    came = spark.readStream.schema(seen.schema).parquet(f"{folder}/in")
    out = live.attribute_stream(came, _IDLE, late="1000 days").where("seq is not null")
    q = live.with_state(spark, out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").start, live.state_partitions(spark))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("session_id", "seq", "source", "vendor", "landing")


def _payload_sql(every: bool) -> str:
    rank = "" if every else "QUALIFY row_number() OVER (PARTITION BY seq ORDER BY k) = 1"
    tools = values([(i, *x) for i, x in enumerate(sessions.TOOLS)], "k, tool, event, prop")
    return f"""SELECT seq, tool, CASE WHEN tool = 'fathom' THEN event || source ELSE event END AS event, prop AS property, CASE WHEN tool <> 'fathom' THEN source END AS value
    FROM (SELECT *, seq % 3 = 0 AS a, seq % 4 = 0 AS b FROM ({_ATTRIBUTED}) WHERE landing) q, {tools}
    WHERE CASE tool WHEN 'ga4' THEN a WHEN 'fathom' THEN TRUE WHEN 'matomo' THEN b WHEN 'gtm' THEN NOT a ELSE FALSE END {rank}"""


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda k, name: F.when(F.col("seq") % k == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    won = sessions.landings(sessions.attribute(views(spark, sf_dir)))
    return won.withColumn("tools", F.concat(F.array(F.lit("gtm"), F.lit("unknown"), F.lit("fathom")), has(4, "matomo"), has(3, "ga4"))).select("seq", "source", "tools")


@query("dispatch_payloads", _payload_sql(False))
def dispatch_payloads(spark, sf_dir):
    return sessions.payloads(_landed(spark, sf_dir)).select("seq", "tool", "event", "property", "value")


@query("dispatch_payloads_all", _payload_sql(True))
def dispatch_payloads_all(spark, sf_dir):
    return sessions.payloads(_landed(spark, sf_dir), every=True).select("seq", "tool", "event", "property", "value")


@query("dispatch_outbox", _payload_sql(True))
def dispatch_outbox(spark, sf_dir):
    """Payloads as the sink has them, in batches that were written twice."""
    from botledger.streaming import outbox

    folder = f"{shared_folder(spark)}/outbox"
    sent = sessions.payloads(_landed(spark, sf_dir), every=True).select("seq", "tool", "event", "property", "value")
    for _ in range(2):
        for half in range(2):
            outbox.post(sent.where(F.col("seq") % 2 == half), folder, batch=f"half-{half}")
    return outbox.read(spark, folder, "seq long, tool string, event string, property string, value string").drop("batch")


#: Requests whose agent may name one of thousands of bots, a customer each, beside the crawlers of the catalogue.
_BOT_UA = "ua || CASE WHEN event_id % 3 = 0 THEN ' (Bot-' || CAST(event_id * 7 % 2003 AS VARCHAR) || '-x/2.1)' ELSE '' END"


@query(
    "classify_by_join",
    f"""SELECT event_id, CASE WHEN length(crawler_token) >= length(coalesce(bot, '')) THEN q.crawler ELSE coalesce('customer-' || CAST(c_custkey AS VARCHAR), q.crawler) END AS crawler_id,
    CASE WHEN q.crawler IS NULL AND c_custkey IS NULL THEN any_product END AS referral_id
    FROM (SELECT r.*, k.token AS crawler_token, CASE WHEN event_id % 3 = 0 THEN 'bot-' || CAST(event_id * 7 % 2003 AS VARCHAR) || '-x' END AS bot FROM ({req_sql()}) r
      LEFT JOIN {values([(c[1], c[4]) for c in catalogue.CRAWLERS], 'id, token').replace('AS v(', 'AS k(')} ON k.id = r.crawler) q
    LEFT JOIN customer ON 'bot-' || CAST(c_custkey AS VARCHAR) || '-x' = bot""",
)
def classify_by_join(spark, sf_dir):
    """A catalogue of a token for each customer beside the built-in ones, as joins."""
    from botledger.operators import signals

    own = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("BOT-"), F.col("c_custkey").cast("string"), F.lit("-X")).alias("token"), (F.col("c_custkey") + 1_000).alias("ord")
    )
    req = requests(spark, sf_dir).select("event_id", F.expr(_BOT_UA.replace("VARCHAR", "STRING")).alias("ua"), "referrer")
    out = signals.classify_by(req, signals.token_frame(spark).unionByName(own), signals.host_frame(spark))
    return out.select("event_id", "crawler_id", "referral_id")


#: Values that someone might check: agents, referrers, hosts with and without a port.
_CHECKED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ua WHEN 1 THEN referrer WHEN 2 THEN regexp_extract(referrer, '^https?://(?:[^@/]*@)?([^/?#:]*)', 1) ELSE 'shop-' || CAST(user_id AS VARCHAR) || '.example:8080/' END AS value, crawler, any_product
    FROM req_"""


@query(
    "check_output",
    f"""SELECT event_id, CASE WHEN id IS NULL THEN NULL WHEN event_id % 4 = 0 THEN 'crawler' ELSE 'referral' END AS kind, id,
    CASE WHEN id IS NULL AND event_id % 4 IN (1, 2) AND regexp_matches(value, '^[a-z0-9-]+([.][a-z0-9-]+)+$') THEN 'https://' || value || '/' WHEN event_id % 4 = 3 THEN 'https://' || value END AS did_you_mean
    FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN crawler WHEN 1 THEN CASE WHEN regexp_matches(value, '^[A-Za-z]+://') THEN any_product END END AS id FROM ({_CHECKED.replace('req_', f'({req_sql()})')}))""",
)
def check_output(spark, sf_dir):
    """What a check says of each value."""
    values_ = spark.sql(_CHECKED.replace("req_", "{req}").replace("VARCHAR", "STRING"), req=requests(spark, sf_dir)).select("event_id", "value")
    return classify.check_values(values_).select("event_id", "match.kind", "match.id", "did_you_mean")


@query("report_top", _top_sql("crawler", 2))
def report_top(spark, sf_dir):
    """A report with two top pages of each crawler, from log files."""
    return report.top_pages(_tally(spark, sf_dir), "crawler", 2)


@query("read_odd_bytes", f"""SELECT event_id, replace(ua, 'Mozilla', chr(65533) || 'ozilla') AS ua, path, CAST(status AS INTEGER) AS status FROM {_GOOD}""")
def read_odd_bytes(spark, sf_dir):
    """Files that start with a byte-order mark, which stays with the first line, and hold bytes that are no UTF-8, which become U+FFFD."""
    folder = shared_folder(spark)

    def write(nth, part):
        lines_ = part.sort_values("line_no")
        text = "".join(f"{n}-{x}\n" if not x.startswith("broken") else f"{x}\n" for n, x in zip(lines_["line_no"], lines_["line"]))
        with stores.create(f"{folder}/odd-{nth[0]}") as f:
            f.write(b"\xef\xbb\xbf" + text.encode().replace(b"Mozilla", b"\xffozilla"))
        return pd.DataFrame({"size": [len(text)]})

    rows = combined_lines(requests(spark, sf_dir)).withColumn("nth", F.floor(F.col("line_no") / _EVENTS_A_FILE))
    rows.groupBy("nth").applyInPandas(write, "size long").write.format("noop").mode("overwrite").save()
    found = lines.parse_source(logfiles.read_lines(spark, folder, fmt="combined", split=True, splitBytes=100_000), keep=("line",)).where("outcome = 'record'")
    number = F.regexp_extract("line", "^\ufeff?([0-9]+)-", 1).cast("long")
    return found.select(number.alias("event_id"), "ua", "path", "status")


@query("announce_landings", f"SELECT session_id, seq, source FROM ({_ATTRIBUTED}) WHERE landing")
def announce_landings(spark, sf_dir):
    """Landings as a sink got them that stands behind one that fails."""
    from botledger.streaming import live, outbox

    folder = f"{shared_folder(spark)}/outbox"

    def fails(landed):
        raise RuntimeError("this sink fails")

    won = sessions.landings(sessions.attribute(views(spark, sf_dir))).select("session_id", "seq", "source")
    if len(live.announce(won, [fails, lambda landed: outbox.post(landed, folder, batch="1")])) != 1:
        raise RuntimeError("a sink too many failed")
    return outbox.read(spark, folder, "session_id string, seq long, source string").drop("batch")
