"""The engine's front: from files, texts or frames of lines to reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botledger.operators import classify, lines, report, robots, sessions, sitefiles
from botledger.plans.watch import watched
from botledger.sources import catalogue, logfiles


class Engine:
    """``Engine(spark).report(["access.log", "cdn.log.gz"]).to_dict()``"""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    # sources
    def lines(self, paths: str | list[str], **options: object) -> DataFrame:
        return logfiles.read_lines(self.spark, paths, **options)

    def parse(self, paths: str | list[str], fmt: str | None = None, **options: object) -> DataFrame:
        """Parsed lines (file, line_no, line, outcome, ts, path, status, ua, referrer) of files in any mix of formats; a file of unknown format is an error, unless lenient (see logfiles)."""
        if fmt is None and not options.get("lenient"):
            heads = self.lines(paths, head=True)
            logfiles.check_formats(heads.where("fmt is null").select("file", F.col("line").alias("first")))
        return lines.parse_lines(self.lines(paths, fmt=fmt, **options).where("line_no is not null"))

    def parse_text(self, text: str, fmt: str | None = None) -> DataFrame:
        return lines.parse_lines(logfiles.with_format(logfiles.lines_from_text(self.spark, text), fmt))

    def file_stats(self, paths: str | list[str], fmt: str | None = None, **options: object) -> DataFrame:
        """(file, fmt, lines, records, skipped, truncated) of each file, in one pass."""
        parsed = lines.parse_lines(self.lines(paths, fmt=fmt, **options), keep=["file", "line_no", "truncated", "fmt"])
        count = lambda cond: F.count_if(F.col("line_no").isNotNull() & cond)
        return parsed.groupBy("file").agg(
            F.max("fmt").alias("fmt"), count(F.lit(True)).alias("lines"), count(F.col("outcome") == "record").alias("records"),
            count(F.col("outcome") == "malformed").alias("skipped"), F.max("truncated").alias("truncated"),
        )

    # reports
    def report(
        self, paths: str | list[str], fmt: str | None = None, since: datetime | str | None = None, top: int = report.DEFAULT_TOP, own_host: str | None = None, **options: object
    ) -> report.Report:
        """The report of files in any mix of formats, each read once, long plain ones in ranges; a file of unknown format is an error, unless lenient (see logfiles)."""
        since = _since(since)
        if top < 1:
            raise ValueError("top must be 1 or more")
        rows = self.lines(paths, fmt=fmt, **{"split": True} | options)
        rep = report.build_report(lines.parse_source(rows, fmt), since, top, own_host)
        if not options.get("lenient"):
            try:
                logfiles.check_formats(rep.files.where("first is not null"))
            except BaseException:
                rep.release()
                raise
        return rep

    def watch(self, action, progress=None, abort=None):
        """action() with a callback for tasks done and planned, and an event that stops it: ``engine.watch(lambda: engine.report(paths).to_dict(), print)``."""
        return watched(self.spark, action, progress, abort)

    def report_text(self, text: str, fmt: str | None = None, **options: object) -> report.Report:
        return report.build_report(self.parse_text(text, fmt), **options)

    def check(self, value: str, own_host: str | None = None) -> DataFrame:
        return classify.check(self.spark, value, own_host)

    # sites
    def robots(self, text: str | None, doc: str = "robots.txt") -> DataFrame:
        return robots.verdicts(self.spark.createDataFrame([(doc, text)], "doc string, text string")).orderBy("ord")

    def llms(self, text: str) -> DataFrame:
        df = self.spark.createDataFrame([(text,)], "text string")
        return df.select(sitefiles.llms_title(F.col("text")).alias("title"), sitefiles.llms_links(F.col("text")).alias("links"))

    def site_files(self, fetched: DataFrame) -> DataFrame:
        """fetched(host, name, status, text) plus outcome and mark."""
        return fetched.withColumn("outcome", sitefiles.file_outcome(F.col("status"), F.col("text"))).withColumn("mark", sitefiles.file_mark(F.col("outcome")))

    def sessions(self, views: DataFrame) -> DataFrame:
        return sessions.attribute(views)

    def crawlers(self) -> DataFrame:
        return catalogue.crawlers(self.spark)

    def referrers(self) -> DataFrame:
        return catalogue.referrers(self.spark)


def _since(value: datetime | str | None) -> datetime | None:
    return report.parse_since(value) if isinstance(value, str) else value


def page_view(rep: report.Report) -> dict[str, DataFrame]:
    """The report as a page shows it: three pages to a cell, times without zone, general search engines apart."""
    def cells(top: DataFrame) -> DataFrame:
        few = top.where("rank <= 3").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("p"))
        return few.select("id", F.array_join(F.transform("p", lambda x: x["path"]), "\n").alias("pages"))

    seen = F.substring(F.replace("last_seen", F.lit("T"), F.lit(" ")), 1, 16).alias("seen")
    crawlers = rep.crawlers.join(cells(rep.crawler_pages), "id", "left")
    cols = ["id", "vendor_name", "token", "purpose", "requests", "unique_pages", "pages"]
    return {
        "crawlers": crawlers.where("ai_specific").select(*cols, seen).orderBy(F.desc("requests"), "id"),
        "search_engines": crawlers.where("not ai_specific").select(*cols, seen).orderBy(F.desc("requests"), "id"),
        "referrals": rep.referrals.join(cells(rep.referral_pages), "id", "left")
        .select("id", "vendor_name", "product", "visits", "unique_pages", "pages", seen).orderBy(F.desc("visits"), "id"),
        "pages": rep.pages,
        "summary": rep.summary,
    }
