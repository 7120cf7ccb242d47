"""Session attribution: which AI product brought a visitor, for every page view of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.operators.classify import referral_id
from botledger.sources import catalogue

REVISITS = ("reload", "back_forward")

# Tool, event name and property that carries the product, in order of preference.
TOOLS = [
    ("ga4", "ai_referral", "ai_source"),
    ("plausible", "AI Referral", "source"),
    ("posthog", "ai_referral", "source"),
    ("fathom", "AI Referral - ", ""),
    ("umami", "ai_referral", "source"),
    ("matomo", "AI Referral", ""),
    ("gtm", "ai_referral", "ai_source"),
]


def vendor_of(source):
    out = F.lit(None).cast("string")
    for r in catalogue.REFERRERS:
        out = F.when(source == r[1], F.lit(r[2])).otherwise(out)
    return out


def attribute(views: DataFrame, idle_minutes: int | None = None) -> DataFrame:
    """views(session_id, ts, seq, referrer, hostname, nav_type) plus source, vendor, landing.

    A view that a referral brought starts afresh; other views carry the last one over, never as
    a landing; a reload or a step back is no landing either. Views go in order of ts, seq. With
    idle_minutes, nothing is carried over a longer gap between views: the session has ended.
    """
    own = referral_id(F.col("referrer"), F.col("hostname"))
    seen, keys = views.withColumn("_own", own), ["session_id"]
    order = W.partitionBy("session_id").orderBy("ts", "seq")
    if idle_minutes is not None:
        gap = F.col("ts") > F.lag("ts").over(order) + F.make_dt_interval(mins=F.lit(idle_minutes))
        seen = seen.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_visit", F.sum("_gap").over(order.rowsBetween(W.unboundedPreceding, 0)))
        keys.append("_visit")
    carried = F.last("_own", ignorenulls=True).over(W.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0))
    out = seen.withColumn("source", carried).drop("_gap", "_visit")
    landing = F.col("_own").isNotNull() & ~F.coalesce(F.col("nav_type").isin(*REVISITS), F.lit(False))
    return out.withColumn("vendor", vendor_of(F.col("source"))).withColumn("landing", F.when(F.col("source").isNotNull(), landing)).drop("_own")


def landings(attributed: DataFrame) -> DataFrame:
    return attributed.where("landing")


def payloads(landed: DataFrame, every: bool = False) -> DataFrame:
    """landed(..., source, tools array<string>) with one row per event sent: tool, event, property, value.

    The first tool of TOOLS that the page has gets the event, or with ``every`` each of them.
    A page with ga4 has its gtm left out, since that is the same data layer.
    """
    rank = F.create_map(*[x for i, (name, _, _) in enumerate(TOOLS) for x in (F.lit(name), F.lit(i))])
    usable = F.filter("tools", lambda x: F.map_contains_key(rank, x) & ~((x == "gtm") & F.array_contains("tools", F.lit("ga4"))))
    ordered = F.array_sort(F.transform(usable, lambda x: F.struct(F.try_element_at(rank, x).alias("k"), x.alias("tool"))))
    sent = landed.withColumn("_t", F.explode(ordered if every else F.slice(ordered, 1, 1))).withColumn("tool", F.col("_t.tool")).drop("_t")
    case = lambda i: F.coalesce(*[F.when(F.col("tool") == x[0], F.lit(x[i])) for x in TOOLS])
    event = F.when(F.col("tool") == "fathom", F.concat(case(1), F.col("source"))).otherwise(case(1))
    return sent.withColumn("event", event).withColumn("property", case(2)).withColumn("value", F.when(F.col("tool") != "fathom", F.col("source")))
