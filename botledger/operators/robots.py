"""robots.txt as relations: groups, decisions, and a verdict with its evidence for every known crawler.

Files are rows (doc, text). Lines become rows; a group number is a running count. A verdict is
worked out once for each distinct list of rules that some crawler falls under anywhere (see
rulesets): its rules are an array bounded by the characters a file may have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.functions.text import web_trim
from botledger.operators.rulesets import MAX_EVIDENCE, evaluate, longest_matches
from botledger.sources import catalogue

#: Characters of a file that are read; the rest is ignored.
MAX_CHARS = 512_000

def _lines(docs: DataFrame) -> DataFrame:
    text = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", ""), 1, MAX_CHARS)
    rows = docs.select("doc", F.posexplode(F.split(text, "\r\n|\r|\n", -1)).alias("at", "raw"))
    body = web_trim(F.substring_index("raw", "#", 1))
    colon = F.instr(body, ":")
    key = F.lower(web_trim(F.left(body, F.greatest(colon - 1, F.lit(0)))))
    return rows.select(
        "doc", (F.col("at") + 1).alias("line"), web_trim(F.col("raw")).alias("text"), F.when(colon > 0, key).alias("key"), web_trim(F.substring(body, colon + 1, F.lit(1 << 30))).alias("value")
    ).where(F.col("key").isin("user-agent", "allow", "disallow"))


def parse(docs: DataFrame) -> DataFrame:
    """(doc, grp, line, text, key, value, product): lines of groups; grp counts from 1; product is set on agent lines.

    Agent lines that follow each other share a group, one after a rule opens the next; rules before any agent are dropped.
    """
    order = W.partitionBy("doc").orderBy("line")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("allow")) != "user-agent")
    grouped = _lines(docs).withColumn("_open", opens.cast("int")).withColumn("grp", F.sum("_open").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    product = F.when(F.startswith("value", F.lit("*")), F.lit("*")).otherwise(F.lower(F.regexp_extract("value", "^[A-Za-z_-]+", 0)))
    return grouped.where("grp > 0").select("doc", "grp", "line", "text", "key", "value", F.when(F.col("key") == "user-agent", product).alias("product"))


def decide(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """(case, path, allowed, line): what the rules(case, line, allow, pattern) of its case say on each of the paths(case, path).

    The longest matching rule decides; on equal lengths Allow wins, then the earlier line; without a match a path is allowed (line null).
    """
    return longest_matches(rules, paths.select("case", "path").distinct(), ["case"])


def _sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed lines, the agent lines that some crawler goes by, and (doc, product, grp): the groups that hold for each."""
    parsed = parse(docs.where("text is not null"))
    agents = parsed.where("product is not null").select("doc", "grp", "line", "text", "product")
    wanted = agents.where(F.col("product").isin("*", *[c[4].lower() for c in catalogue.CRAWLERS]))
    return parsed, wanted, wanted.select("doc", "product", "grp").distinct()


def page_access(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, path, id, source, allowed, line): whether each crawler may fetch each distinct path of pages(doc, path), and the line that says so.

    A site without a file, or whose file has no group for a crawler, allows all (source ``none``); a null doc or path has no row.
    """
    parsed, _, sets = _sets(docs)
    grouped = sets.join(parsed.where("key <> 'user-agent'").drop("product", "text"), ["doc", "grp"])
    rules = grouped.select("doc", "product", "line", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    paths = pages.select("doc", "path").where("doc is not null and path is not null").distinct()
    said = paths.join(sets.select("doc", "product").distinct(), "doc", "left")
    told = longest_matches(rules, said.where("product is not null"), ["doc", "product"])
    by_path = told.groupBy("doc", "path").agg(F.map_from_entries(F.collect_list(F.struct("product", F.struct("allowed", "line")))).alias("told"))
    crawlers = F.array(*[F.struct(F.lit(c[1]).alias("id"), F.lit(c[4].lower()).alias("product")) for c in catalogue.CRAWLERS])
    rows = paths.join(by_path, ["doc", "path"], "left").select("doc", "path", "told", F.explode(crawlers).alias("c"))
    use = F.when(F.map_contains_key("told", F.col("c.product")), F.col("c.product")).when(F.map_contains_key("told", "*"), "*")
    rows = rows.select("doc", "path", "c.id", use.alias("use"), F.when(use.isNotNull(), F.try_element_at("told", use)).alias("said"))
    source = F.when(F.col("use") == "*", "star").when(F.col("use").isNotNull(), "token").otherwise("none")
    return rows.select("doc", "path", "id", source.alias("source"), F.coalesce("said.allowed", F.lit(True)).alias("allowed"), "said.line")


def verdicts(docs: DataFrame) -> DataFrame:
    """One row for each doc and crawler, in catalogue order (ord): dims, source, verdict, lines (the evidence).

    A null text is a file that doesn't exist: everything is allowed and source is ``none``.
    """
    spark = docs.sparkSession
    crawlers = catalogue.crawlers(spark).withColumn("product", F.lower("token"))
    parsed, wanted, sets = _sets(docs)
    own = F.when(F.col("key") != "user-agent", F.struct(F.col("line"), F.col("text"), (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern")))
    by_set = sets.join(parsed.drop("product"), ["doc", "grp"]).groupBy("doc", "product").agg(F.sort_array(F.collect_list(own)).alias("rules"))
    shown = wanted.groupBy("doc", "product").agg(F.slice(F.sort_array(F.collect_list(F.struct("line", "text"))), 1, MAX_EVIDENCE).alias("agent_lines"))
    judged = evaluate(by_set).join(shown, ["doc", "product"]).select("doc", "product", "verdict", "agent_lines", "deciding")
    pairs = docs.select("doc").crossJoin(F.broadcast(crawlers))  # the catalogue's few rows for each file
    named = judged.select("doc", "product", F.struct("verdict", "agent_lines", "deciding").alias("named"))
    star = judged.where(F.col("product") == "*").select("doc", F.struct("verdict", "agent_lines", "deciding").alias("star"))
    both = pairs.join(named, ["doc", "product"], "left").join(star, "doc", "left")
    use = F.coalesce("named", "star")
    merged = F.array_sort(F.array_distinct(F.array_union(use["agent_lines"], use["deciding"])))
    none = F.expr("cast(array() as array<struct<line: int, text: string>>)")
    return both.select(
        "doc", "ord", "id", "vendor", "vendor_name", "token", "purpose", "ai_specific", "robots_only",
        F.when(F.col("named").isNotNull(), "token").when(F.col("star").isNotNull(), "star").otherwise("none").alias("source"),
        F.coalesce(use["verdict"], F.lit("allowed")).alias("verdict"),
        F.coalesce(merged, none).alias("lines"),
    )


def verdict_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("doc").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("verdict") == x).alias(x) for x in ("allowed", "blocked", "partial")],
        F.count_if(F.col("source") == "token").alias("named"),
    )


def headline(v: DataFrame) -> DataFrame:
    """(doc, allowed, total, blocked_everywhere, blocked_some, parts): a file's numbers for its headline, and the parts that the line below it has: none, everywhere, some or both."""
    counts = verdict_counts(v)
    parts = F.when((F.col("blocked") > 0) & (F.col("partial") > 0), "both").when(F.col("blocked") > 0, "everywhere").when(F.col("partial") > 0, "some").otherwise("none")
    return counts.select("doc", "allowed", "total", F.col("blocked").alias("blocked_everywhere"), F.col("partial").alias("blocked_some"), parts.alias("parts"))


def vendor_summary(v: DataFrame) -> DataFrame:
    """(doc, vendor, vendor_name, purposes map): one verdict per purpose, ``mixed`` where a vendor's crawlers disagree."""
    per = v.groupBy("doc", "vendor", "vendor_name", "purpose").agg(
        F.when(F.min("verdict") == F.max("verdict"), F.min("verdict")).otherwise("mixed").alias("verdict"), F.min("ord").alias("ord")
    )
    return per.groupBy("doc", "vendor", "vendor_name").agg(
        F.map_from_entries(F.collect_list(F.struct("purpose", "verdict"))).alias("purposes"), F.min("ord").alias("ord")
    )


_RANK = "case verdict when 'blocked' then 0 when 'partial' then 1 else 2 end"


def purpose_groups(v: DataFrame) -> DataFrame:
    """(doc, purpose, blocked, partial, allowed, rows): crawlers of each purpose, blocked ones first, with their evidence in a line."""
    row = F.struct(
        F.expr(_RANK).alias("rank"), "ord", "token", "vendor_name", "verdict",
        F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x["text"]), "  ")).alias("evidence"),
    )
    return v.groupBy("doc", "purpose").agg(
        *[F.count_if(F.col("verdict") == x).alias(x) for x in ("blocked", "partial", "allowed")], F.array_sort(F.collect_list(row)).alias("rows")
    )


def vendor_buckets(v: DataFrame) -> DataFrame:
    """(doc, purpose, blocked, some, allowed, kind): vendor names by what they get; kind all, none or mixed."""
    flat = vendor_summary(v).select("doc", "vendor_name", "ord", F.explode("purposes").alias("purpose", "verdict"))
    names = lambda *vs: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("verdict").isin(*vs), F.struct("ord", "vendor_name")))), lambda x: x["vendor_name"]
    )
    out = flat.groupBy("doc", "purpose").agg(names("blocked").alias("blocked"), names("partial", "mixed").alias("some"), names("allowed").alias("allowed"))
    kind = F.when((F.size("blocked") == 0) & (F.size("some") == 0), "all").when((F.size("allowed") == 0) & (F.size("some") == 0), "none").otherwise("mixed")
    return out.withColumn("kind", kind)


def next_crawler(docs: DataFrame, v: DataFrame) -> DataFrame:
    """(doc, outlook): what a crawler named nowhere will get: ``none`` without a file, else ``open`` or ``closed``."""
    star = parse(docs.where("text is not null")).where(F.col("product") == "*").select("doc").distinct().withColumn("has_star", F.lit(True))
    said = v.where(F.col("source") == "star").groupBy("doc").agg(F.min_by("verdict", "ord").alias("star_verdict"))
    rows = docs.select("doc", F.col("text").isNull().alias("absent")).join(star, "doc", "left").join(said, "doc", "left")
    closed = F.col("star_verdict").isNull() | (F.col("star_verdict") == "blocked")
    return rows.select("doc", F.when(F.col("absent"), "none").when(F.col("has_star").isNull() | ~closed, "open").otherwise("closed").alias("outlook"))
