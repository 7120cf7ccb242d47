"""The report: summary, crawlers, referrals and pages from one tally per (kind, id, path).

Distinct pages come free from the tally, so nothing counts distinct values twice; top pages
per id are a rank filter, which the planner applies before the shuffle as well as after it.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.functions.text import utc_text
from botledger.operators.classify import classify
from botledger.sources import catalogue

DEFAULT_TOP = 10


def parse_since(value: str, now: datetime | None = None) -> datetime:
    """``30m``, ``24h``, ``7d``, ``2w`` before now, or an ISO date or time (UTC unless it says otherwise)."""
    text = value.strip()
    if m := re.fullmatch(r"([0-9]+)([mhdw])", text, re.I):
        unit = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2].lower()]
        return (now or datetime.now(timezone.utc)) - timedelta(**{unit: int(m[1])})
    try:
        when = datetime.fromisoformat(re.sub("[zZ]$", "+00:00", text))
    except ValueError:
        raise ValueError(f"not a time or a span like 24h: {value!r}") from None
    return when.astimezone(timezone.utc) if when.tzinfo else when.replace(tzinfo=timezone.utc)


def tally(records: DataFrame, since: datetime | None = None, own_host: str | None = None) -> DataFrame:
    """(kind, id, path, n, last_seen): one row for each page that a crawler or a product's visitors asked for."""
    if since is not None:
        records = records.where(F.col("ts") >= F.lit(since.astimezone(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"))
    tagged = classify(records, own_host).where("crawler_id is not null or referral_id is not null")
    return tagged.groupBy(
        F.when(F.col("crawler_id").isNotNull(), "crawler").otherwise("referral").alias("kind"),
        F.coalesce("crawler_id", "referral_id").alias("id"),
        "path",
    ).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))


def tagged_lines(parsed: DataFrame, since: datetime | None = None, own_host: str | None = None) -> DataFrame:
    """(kind, id, path, note, ts) of each parsed line.

    kind is ``crawler`` or ``referral`` for what tally() counts; ``lines`` for all other lines, by outcome (id) and
    file (path); ``file`` for the status rows of the reader (line_no null), id ``whole`` or ``damaged``, with the first
    line of a file of unknown format as note.
    """
    tagged = classify(parsed.select("file", "line_no", "truncated", "note", "outcome", "ts", "path", "ua", "referrer"), own_host)
    status = F.col("line_no").isNull()
    hit = ~status & (F.col("crawler_id").isNotNull() | F.col("referral_id").isNotNull())
    if since is not None:
        hit = hit & (F.col("ts") >= F.lit(since.astimezone(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"))
    hit = F.coalesce(hit, F.lit(False))
    return tagged.select(
        F.when(status, "file").when(~hit, "lines").when(F.col("crawler_id").isNotNull(), "crawler").otherwise("referral").alias("kind"),
        F.when(status, F.when(F.col("truncated"), "damaged").otherwise("whole")).when(~hit, F.col("outcome")).otherwise(F.coalesce("crawler_id", "referral_id")).alias("id"),
        F.when(hit, F.col("path")).otherwise(F.col("file")).alias("path"),
        "note",
        "ts",
    )


def tally_lines(parsed: DataFrame, since: datetime | None = None, own_host: str | None = None) -> DataFrame:
    """(kind, id, path, note, n, last_seen): everything a report needs from parsed lines (see tagged_lines), in one pass and one shuffle."""
    return tagged_lines(parsed, since, own_host).groupBy("kind", "id", "path", "note").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))


def _by_id(t: DataFrame, kind: str, count: str) -> DataFrame:
    """Requests, pages and last time of each id; rows that stand for several pages say how many in ``pages``."""
    pages = F.sum("pages").cast("long") if "pages" in t.columns else F.count(F.lit(1))
    return t.where(F.col("kind") == kind).groupBy("id").agg(F.sum("n").cast("long").alias(count), pages.alias("unique_pages"), F.max("last_seen").alias("last_seen"))


def crawler_rows(t: DataFrame) -> DataFrame:
    """id, vendor, vendor_name, token, purpose, ai_specific, requests, unique_pages, last_seen; most requests first."""
    dims = catalogue.crawlers(t.sparkSession).select("id", "vendor", "vendor_name", "token", "purpose", "ai_specific")
    rows = _by_id(t, "crawler", "requests").join(F.broadcast(dims), "id")
    return rows.select("id", "vendor", "vendor_name", "token", "purpose", "ai_specific", "requests", "unique_pages", utc_text(F.col("last_seen")).alias("last_seen")).orderBy(
        F.desc("requests"), "id"
    )


def referral_rows(t: DataFrame) -> DataFrame:
    """id, vendor, vendor_name, product, visits, unique_pages, last_seen; most visits first."""
    dims = catalogue.referrers(t.sparkSession).select("id", "vendor", "vendor_name", "product")
    rows = _by_id(t, "referral", "visits").join(F.broadcast(dims), "id")
    return rows.select("id", "vendor", "vendor_name", "product", "visits", "unique_pages", utc_text(F.col("last_seen")).alias("last_seen")).orderBy(F.desc("visits"), "id")


def coverage_gaps(t: DataFrame) -> DataFrame:
    """(path, kind, id): the crawlers that user agents name and the products of the catalogue that did not come to a page of the tally."""
    listed = [("crawler", c[1]) for c in catalogue.CRAWLERS if not c[7]] + [("referral", r[1]) for r in catalogue.REFERRERS]
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("id")) for kind, i in listed]))
    seen = t.where(F.col("kind").isin("crawler", "referral")).select("path", "kind", "id")
    return seen.select("path").distinct().select("path", each.alias("c")).select("path", "c.kind", "c.id").join(seen, ["path", "kind", "id"], "left_anti")


def top_pages(t: DataFrame, kind: str, top: int = DEFAULT_TOP) -> DataFrame:
    """(id, rank, path, n): each id's most asked-for pages, ties by path."""
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "path"))
    return t.where(F.col("kind") == kind).select("id", "path", "n").withColumn("rank", rank).where(F.col("rank") <= top).select("id", "rank", "path", "n")


def page_tally(t: DataFrame) -> DataFrame:
    """(path, kind, label, n) of the pages pivot: AI crawlers by token, referrals by product; general search engines are left out."""
    spark = t.sparkSession
    labels = catalogue.crawlers(spark).where("ai_specific").select(F.lit("crawler").alias("kind"), "id", F.col("token").alias("label"))
    labels = labels.unionByName(catalogue.referrers(spark).select(F.lit("referral").alias("kind"), "id", F.col("product").alias("label")))
    return t.join(F.broadcast(labels), ["kind", "id"]).groupBy("path", "kind", "label").agg(F.sum("n").cast("long").alias("n"))


def page_rows(t: DataFrame, top: int = DEFAULT_TOP) -> DataFrame:
    """path, crawler_requests, referral_visits, crawlers, referrals of the pages with most of both; ties by path."""
    entry = F.struct((-F.col("n")).alias("k"), F.col("label").alias("name"))
    grouped = page_tally(t).groupBy("path").agg(
        F.sum(F.when(F.col("kind") == "crawler", F.col("n")).otherwise(0)).alias("crawler_requests"),
        F.sum(F.when(F.col("kind") == "referral", F.col("n")).otherwise(0)).alias("referral_visits"),
        *[
            F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))), lambda e: F.struct(e["name"].alias("name"), (-e["k"]).alias("n"))).alias(name)
            for k, name in (("crawler", "crawlers"), ("referral", "referrals"))
        ],
    )
    return grouped.orderBy(F.desc(F.col("crawler_requests") + F.col("referral_visits")), "path").limit(top)


def summary(t: DataFrame) -> DataFrame:
    """One row from tally_lines(): records and skipped of all lines (before any cut by time), AI crawler requests, AI referral visits."""
    general = [c[1] for c in catalogue.CRAWLERS if not c[6]]
    hit = F.col("kind").isin("crawler", "referral")
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return t.agg(
        total(hit | ((F.col("kind") == "lines") & (F.col("id") == "record")), "records"),
        total((F.col("kind") == "lines") & (F.col("id") == "malformed"), "skipped"),
        total((F.col("kind") == "crawler") & ~F.col("id").isin(*general), "ai_crawler_requests"),
        total(F.col("kind") == "referral", "ai_referral_visits"),
    )


@dataclass(frozen=True)
class Report:
    """The report's frames, all derived from one tally (kept by the executors until release(), and worked out again where one is lost).

    files says for each file that was read whether it is damaged, and the first line of one whose format is unknown.
    to_dict() brings the few rows that the report itself has to the driver.
    """

    tally: DataFrame
    files: DataFrame
    summary: DataFrame
    crawlers: DataFrame
    referrals: DataFrame
    pages: DataFrame
    crawler_pages: DataFrame
    referral_pages: DataFrame

    def release(self) -> None:
        self.tally.unpersist()

    def to_dict(self) -> dict:
        frames = [self.summary, self.crawlers, self.referrals, self.pages, self.crawler_pages.orderBy("id", "rank"), self.referral_pages.orderBy("id", "rank")]
        with ThreadPoolExecutor(len(frames)) as pool:  # small jobs on one kept tally: side by side
            summary, crawlers, referrals, pages, *tops = [f.result() for f in [pool.submit(inheritable_thread_target(self.tally.sparkSession)(df.collect)) for df in frames]]
        by_id: list[dict[str, list]] = [{}, {}]
        for rows, own in zip(tops, by_id):
            for r in rows:
                own.setdefault(r["id"], []).append({"path": r["path"], "count": r["n"]})
        return {
            "summary": summary[0].asDict(),
            "crawlers": [r.asDict() | {"top_pages": by_id[0].get(r["id"], [])} for r in crawlers],
            "referrals": [r.asDict() | {"top_pages": by_id[1].get(r["id"], [])} for r in referrals],
            "pages": [
                {
                    "path": p["path"], "crawler_requests": p["crawler_requests"], "referral_visits": p["referral_visits"],
                    "crawlers": [{"token": e["name"], "count": e["n"]} for e in p["crawlers"]],
                    "referrals": [{"product": e["name"], "count": e["n"]} for e in p["referrals"]],
                }
                for p in pages
            ],
        }


def report_of(t: DataFrame, top: int = DEFAULT_TOP) -> Report:
    """The frames of a report from tally_lines()."""
    if top < 1:
        raise ValueError("top must be 1 or more")
    files = t.where("kind = 'file'").select(F.col("path").alias("file"), (F.col("id") == "damaged").alias("damaged"), F.col("note").alias("first"))
    return Report(t, files, summary(t), crawler_rows(t), referral_rows(t), page_rows(t, top), top_pages(t, "crawler", top), top_pages(t, "referral", top))


def running_report(totals: DataFrame, top_rows: DataFrame, files: DataFrame, top: int = DEFAULT_TOP) -> Report:
    """The frames of a report from totals(kind, id, n, pages, last_seen) over parts of the pages and the tally's rows of each part's top pages."""
    return Report(
        top_rows, files, summary(totals), crawler_rows(totals), referral_rows(totals), page_rows(top_rows, top), top_pages(top_rows, "crawler", top), top_pages(top_rows, "referral", top)
    )


def build_report(parsed: DataFrame, since: datetime | None = None, top: int = DEFAULT_TOP, own_host: str | None = None) -> Report:
    """The report of parsed lines, read once however many of its frames are used; its owner releases it."""
    return report_of(whole_tally(parsed, since, own_host).persist(), top)


def whole_tally(parsed: DataFrame, since: datetime | None = None, own_host: str | None = None) -> DataFrame:
    """tally_lines() of parsed lines of any source, with or without damage marks and notes."""
    return tally_lines(with_marks(parsed), since, own_host)


def with_marks(parsed: DataFrame) -> DataFrame:
    """parsed lines with the columns truncated and note, null where their source has none."""
    for name, kind in (("truncated", "boolean"), ("note", "string")):
        if name not in parsed.columns:
            parsed = parsed.withColumn(name, F.lit(None).cast(kind))
    return parsed
