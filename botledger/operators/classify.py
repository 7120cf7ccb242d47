"""Classification of requests: crawlers by user agent, AI referrals by referrer.

Both are literal expressions built from the catalogue, so they stay in whole-stage codegen
and need no join; the catalogue's other fields are joined after aggregation, to a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botledger.functions import text as t
from botledger.functions import urls as u
from botledger.plans.settle import settle
from botledger.sources import catalogue


def _crawler_of(low: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(low, F.lit(tok)), F.lit(cid)) for tok, cid in catalogue.tokens_by_precedence()])


def crawler_id(ua: Column) -> Column:
    """Id of the crawler whose token a user agent holds: any case, longest token first; null if none."""
    return F.transform(F.array(F.lower(ua)), _crawler_of)[0]


def _referral_of(host: Column, own: Column | None) -> Column:
    listed = catalogue.hosts()
    deepest = max(h.count(".") + 1 for h in listed)
    by_host = F.create_map(*[F.lit(x) for pair in sorted(listed.items()) for x in pair])
    found = F.coalesce(*[F.try_element_at(by_host, F.substring_index(host, ".", -n)) for n in range(deepest, 1, -1)])
    if own is None:
        return found
    return F.when(~F.coalesce((host == own) & (own != ""), F.lit(False)), found)


def _own(own_host: str | Column | None) -> Column | None:
    if own_host is None or (isinstance(own_host, str) and not own_host):
        return None
    return u.normalize_host(F.lit(own_host) if isinstance(own_host, str) else own_host)


def _host(referrer: Column) -> Column:
    return u.normalize_host(u.url_host(t.strip(referrer)))


def referral_id(referrer: Column, own_host: str | Column | None = None) -> Column:
    """Id of the AI product whose host, or a subdomain of it, a referrer names; the site's own host never counts.

    At most as many labels as the longest listed host has are looked at, so long hosts cost linear time.
    """
    own = _own(own_host)
    return F.transform(F.array(_host(referrer)), lambda h: _referral_of(h, own))[0]


def classify(requests: DataFrame, own_host: str | Column | None = None) -> DataFrame:
    """requests(ua, referrer, ...) plus crawler_id and, where that is null, referral_id.

    The lower-cased agent and the host are columns of their own first, so that each is made once per row.
    """
    tagged = requests.withColumn("_low", F.lower("ua")).withColumn("crawler_id", _crawler_of(F.col("_low")))
    hosts = tagged.withColumn("_host", F.when(F.col("crawler_id").isNull() & (F.col("referrer") != ""), _host(F.col("referrer"))))
    found = {"crawler_id": F.col("crawler_id"), "referral_id": _referral_of(F.col("_host"), _own(own_host))}
    return settle(hosts, [c for c in requests.columns if c not in found], found)


def match_struct(crawler: Column, referral: Column) -> Column:
    """struct(kind, id, vendor, vendor_name, product, token, purpose, ai_specific), or null without a match."""

    def of(value: Column, rows: list[tuple[str, str | bool | None]], kind: str = "string") -> Column:
        out = F.lit(None).cast(kind)
        for key, v in rows:
            if v is not None:
                out = F.when(value == key, F.lit(v)).otherwise(out)
        return out

    c, r = catalogue.CRAWLERS, catalogue.REFERRERS
    both = F.coalesce(crawler, referral)
    is_crawler = crawler.isNotNull()
    pick = lambda i, j: F.when(is_crawler, of(crawler, [(x[1], x[i]) for x in c])).otherwise(of(referral, [(x[1], x[j]) for x in r]))
    whole = F.struct(
        F.when(is_crawler, "crawler").otherwise("referral").alias("kind"),
        both.alias("id"),
        pick(2, 2).alias("vendor"),
        pick(3, 3).alias("vendor_name"),
        F.when(~is_crawler, of(referral, [(x[1], x[4]) for x in r])).alias("product"),
        F.when(is_crawler, of(crawler, [(x[1], x[4]) for x in c])).alias("token"),
        F.when(is_crawler, of(crawler, [(x[1], x[5]) for x in c])).alias("purpose"),
        F.when(is_crawler, of(crawler, [(x[1], x[6]) for x in c], "boolean")).otherwise(F.lit(True)).alias("ai_specific"),
    )
    return F.when(both.isNotNull(), whole)


def check(spark: SparkSession, value: str, own_host: str | None = None) -> DataFrame:
    """One row for one value: a URL is tried as a referrer, anything else as a user agent."""
    return check_values(spark.createDataFrame([(value,)], "value string"), own_host)


def check_values(values: DataFrame, own_host: str | None = None) -> DataFrame:
    """values(value, ...) plus match and did_you_mean: a URL is tried as a referrer, anything else as a user agent; a bare host that fits neither gets the URL that may be meant."""
    as_url = u.is_url(F.col("value"))
    made = {
        "crawler": F.when(~as_url, crawler_id(F.col("value"))), "referral": F.when(as_url, referral_id(F.col("value"), own_host)),
    }
    found = settle(values, values.columns, made)
    hint = F.when(F.col("crawler").isNull() & F.col("referral").isNull(), u.bare_host_hint(F.col("value")))
    return found.select(*values.columns, match_struct(F.col("crawler"), F.col("referral")).alias("match"), hint.alias("did_you_mean"))


def log_line(kind: Column, match_id: Column, path: Column) -> Column:
    return F.format_string("ai_traffic kind=%s id=%s path=%s", kind, match_id, path)
