"""Classification by a catalogue of any size, as joins, and catalogues that change while streams run.

Tokens are indexed by the rarest of their stretches of at most GRAM signs. User agents repeat, so
each distinct one is cut into stretches once; those that the index has name the tokens worth a look,
which are verified, and the first by precedence is joined back to the requests. Hosts are looked up
by each of their endings. The plan is the same for thirty tokens and for thirty thousand.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.functions import text as t
from botledger.functions import urls as u
from botledger.sources import catalogue

GRAM = 6


def token_frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(id, token, ord) of the crawlers that user agents name; ``rows`` like catalogue.CRAWLERS."""
    rows = catalogue.CRAWLERS if rows is None else rows
    return spark.createDataFrame([(r[1], r[4], r[0]) for r in rows if not r[7]], "id string, token string, ord long")


def host_frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(id, host) of the products' hosts; ``rows`` like catalogue.REFERRERS."""
    rows = catalogue.REFERRERS if rows is None else rows
    return spark.createDataFrame([(r[1], h) for r in rows for h in r[5]], "id string, host string")


def _stretches(text: Column, size: Column | int) -> Column:
    """The distinct stretches of a text that are so long."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, size)))


def token_index(tokens: DataFrame) -> DataFrame:
    """(gram, low, rank, id) of tokens(id, token, ord): each under the stretch of it that fewest others have; rank puts longer tokens first, then earlier ones."""
    low = tokens.where("token <> ''").select("id", F.lower("token").alias("low"), F.struct((-F.length("token")).alias("size"), "ord", "id").alias("rank"))
    grams = low.withColumn("gram", F.explode(_stretches(F.col("low"), F.least(F.length("low"), F.lit(GRAM)))))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("rank").orderBy("n", "gram")
    return grams.join(often, "gram").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("gram", "low", "rank", "id")


def crawlers_of(agents: DataFrame, tokens: DataFrame) -> DataFrame:
    """(ua, crawler_id) of the distinct agents(ua) that hold a token, in any case; the longest decides, then the catalogue's order."""
    index = token_index(tokens)
    sizes = sorted(r["n"] for r in index.select(F.length("gram").alias("n")).distinct().collect())  # GRAM numbers at most
    if not sizes:
        return agents.select("ua", F.lit(None).cast("string").alias("crawler_id")).where("false")
    cut = agents.select("ua", F.lower("ua").alias("agent")).withColumn("gram", F.explode(F.concat(*[_stretches(F.col("agent"), n) for n in sizes])))
    hits = cut.join(index, "gram").where(F.contains("agent", F.col("low")))
    return hits.groupBy("ua").agg(F.min("rank").alias("best")).select("ua", F.col("best.id").alias("crawler_id"))


def products_of(referrers: DataFrame, hosts: DataFrame, own_host: str | None = None) -> DataFrame:
    """(referrer, referral_id) of the distinct referrers(referrer) whose host, or an ending of it, is listed; the longest ending decides."""
    listed = hosts.select("id", F.regexp_replace(F.rtrim(F.lower("host"), F.lit(".")), r"^www\.", "").alias("ending")).withColumn("deep", F.size(F.split("ending", r"\.")))
    deepest = listed.agg(F.max("deep")).first()[0] or 0
    named = referrers.select("referrer", u.normalize_host(u.url_host(t.strip(F.col("referrer")))).alias("name")).where("name is not null")
    if own_host:
        named = named.where((F.col("name") != u.normalize_host(F.lit(own_host))) | (u.normalize_host(F.lit(own_host)) == ""))
    endings = F.array(*[F.substring_index("name", ".", -n) for n in range(2, deepest + 1)]) if deepest > 1 else F.array().cast("array<string>")
    ends = named.select("referrer", F.explode(F.array_distinct(endings)).alias("ending"))
    hits = ends.join(listed, "ending")
    return hits.groupBy("referrer").agg(F.max_by("id", "deep").alias("referral_id"))


def classify_by(requests: DataFrame, tokens: DataFrame, hosts: DataFrame, own_host: str | None = None) -> DataFrame:
    """requests(ua, referrer, ...) plus crawler_id and, where that is null, referral_id, by tokens(id, token, ord) and hosts(id, host)."""
    agents = crawlers_of(requests.select("ua").where("ua is not null").distinct(), tokens)
    told = requests.join(agents, "ua", "left")
    products = products_of(requests.select("referrer").where("referrer is not null").distinct(), hosts, own_host)
    told = told.join(products, "referrer", "left")
    return told.select(*[c for c in requests.columns], "crawler_id", F.when(F.col("crawler_id").isNull(), F.col("referral_id")).alias("referral_id"))


class Versions:
    """A catalogue file as it is now: read again when it has changed; one that can't be used leaves the last good one in place."""

    def __init__(self, path: str):
        self.path, self.number, self.error = path, 0, None
        self._mark: tuple | None = None
        self._rows: tuple[list[tuple], list[tuple]] = (catalogue.CRAWLERS, catalogue.REFERRERS)

    def rows(self) -> tuple[list[tuple], list[tuple]]:
        """Rows like catalogue.CRAWLERS and REFERRERS; ``number`` counts the versions used, ``error`` says what is wrong with the file."""
        stat = os.stat(self.path)
        if (mark := (stat.st_mtime_ns, stat.st_size, stat.st_ino)) != self._mark:
            self._mark = mark
            try:
                self._rows, self.number, self.error = catalogue.load(self.path), self.number + 1, None
            except ValueError as err:
                self.error = str(err)
                if not self.number:
                    raise
        return self._rows

    def classify(self, requests: DataFrame, own_host: str | None = None) -> DataFrame:
        spark = requests.sparkSession
        crawlers, referrers = self.rows()
        return classify_by(requests, token_frame(spark, crawlers), host_frame(spark, referrers), own_host)


def tag_batches(requests: DataFrame, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, own_host: str | None = None):
    """A query that classifies each micro-batch by the catalogue file as it is at that time, and hands it to the sink with the batch's number."""
    versions = Versions(path)
    one = functools.partial(versions.classify, own_host=own_host)
    return requests.writeStream.foreachBatch(lambda batch, number: sink(one(batch), number)).option("checkpointLocation", checkpoint).start()
