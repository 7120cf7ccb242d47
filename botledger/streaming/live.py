"""Streams: tagging requests, a running report, sessions with state, and callbacks.

The running report is kept by state: each path's counts by crawler and product. A micro-batch reads
and writes the state of the paths that it has, no others, and hands on what it changed: how much
came to each count, whether it is new, and where it stands. From that and the report's last
snapshot - totals by id, and top pages - the next snapshot follows, since counts only grow: top
pages are the best of the old ones and the changed ones. A snapshot has as many rows as ids times
top pages, however long the history.
"""

from __future__ import annotations

import functools
import json
import logging
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from botledger.operators import lines, report, sessions
from botledger.operators.classify import classify, log_line, match_struct
from botledger.sources import catalogue, logfiles

_log = logging.getLogger(__name__)
#: Snapshots of the running report that are kept: the last batch may have to run again.
KEPT = 3
TOP = report.DEFAULT_TOP


def parsed_stream(rows: DataFrame, fmt: str | None = None) -> DataFrame:
    """Parsed lines of a stream: of the ``accesslog`` source in any format (it knows CloudFront's headers), or of plain lines (column value) in a line-by-line one."""
    if "spots" in rows.columns:
        return lines.parse_source(rows, keep=("line",))
    if fmt not in ("combined", "alb"):
        raise ValueError("CloudFront lines depend on headers above them and other formats must be named; read such files through the accesslog source")
    rows = rows.select(
        F.lit("stream").alias("file"), F.lit(0).cast("long").alias("line_no"), F.col("value").alias("line"), F.lit(False).alias("truncated"), F.lit(fmt).alias("fmt"),
        F.lit(None).cast("array<int>").alias("spots"),
    )
    return lines.parse_source(rows, keep=("line",))


def parse_stream(rows: DataFrame, fmt: str | None = None) -> DataFrame:
    """Records of a stream (see parsed_stream)."""
    return lines.records(parsed_stream(rows, fmt))


def log_stream(spark: SparkSession, folder: str, ledger: str, fmt: str | None = None, max_files: int = logfiles.MOST_FILES, lenient: bool = False) -> DataFrame:
    """Parsed lines of the log files that come into a folder, each file once: gzip by magic bytes, kept BOM, any format, as in batch.

    ``ledger`` is a folder for the query's list of files seen; keep it as long as the query's checkpoint. ``lenient`` as in logfiles.
    """
    return parsed_stream(logfiles.stream_lines(spark, folder, ledger, fmt, max_files, lenient))


def tag(requests: DataFrame, own_host: str | None = None) -> DataFrame:
    """requests plus ai_traffic: what each was classified as, or null. Stateless, so any output mode will do."""
    tagged = classify(requests, own_host)
    return tagged.withColumn("ai_traffic", match_struct(F.col("crawler_id"), F.col("referral_id"))).drop("crawler_id", "referral_id")


def header_value(headers: Column, name: str) -> Column:
    """Last value of a header (any case) in array<struct<name, value>>, its bytes read as Latin-1; empty if absent."""
    hits = F.filter(headers, lambda h: F.lower(h["name"].cast("string")) == name.lower())
    return F.coalesce(F.decode(F.get(hits, F.size(hits) - 1)["value"], "ISO-8859-1"), F.lit(""))


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the complete tables ``kind=number`` in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(path(folder))] if files.exists(path(folder)) else []
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{kind}=") and files.exists(path(p, "_SUCCESS")))


_CHANGE = "kind string, id string, path string, note string, n long, fresh boolean, total long, last_seen string, counts string"
_SNAPSHOT = "part string, kind string, id string, path string, n long, pages long, last_seen timestamp_ntz, counts string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"


def _counted(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a batch changed of a path's counts, which the state holds by kind and id; lines that are no hits pass on as they are."""
    df = pd.concat(list(rows))  # a row for each kind, id and Arrow batch at most
    if not key[0]:
        yield df.assign(path=key[1], fresh=False, total=df["n"], counts=None)[[c.split()[0] for c in _CHANGE.split(", ")]]
        return
    was = json.loads(state.get[0]) if state.exists else {}
    now, out = dict(was), {}
    for kind, id_, n, seen in df[["kind", "id", "n", "last_seen"]].itertuples(index=False, name=None):
        name = f"{kind} {id_}"
        now[name] = now.get(name, 0) + n
        own = out.setdefault((kind, id_), [0, name not in was, ""])
        own[0] += n
        own[2] = max(own[2], seen or "")
    counts = json.dumps(now)
    state.update((counts,))
    yield pd.DataFrame([(kind, id_, key[1], None, n, fresh, now[f"{kind} {id_}"], seen or None, counts) for (kind, id_), (n, fresh, seen) in out.items()], columns=[c.split()[0] for c in _CHANGE.split(", ")])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal lines of an Arrow batch as one row, so that a hot page sends a row a batch."""
    names = ["hit", "path", "kind", "id", "note"]
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(names).aggregate([("n", "sum"), ("last_seen", "max")])
        yield from t.rename_columns([*names, "n", "last_seen"]).to_batches()


def running_changes(parsed: DataFrame, own_host: str | None = None) -> DataFrame:
    """Of a stream of parsed lines, what each micro-batch changed of the report's counts (update mode)."""
    tagged = report.tagged_lines(report.with_marks(parsed), own_host=own_host)
    hit, seen = F.col("kind").isin("crawler", "referral"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = tagged.select(hit.alias("hit"), "path", "kind", "id", "note", F.lit(1).cast("long").alias("n"), seen.alias("last_seen"))
    rows = rows.mapInArrow(_combined, "hit boolean, path string, kind string, id string, note string, n long, last_seen string")
    return rows.groupBy("hit", "path").applyInPandasWithState(_counted, _CHANGE, "counts string", "update", GroupStateTimeout.NoTimeout)


def _next(snapshot: DataFrame, changed: DataFrame, top: int) -> DataFrame:
    """The snapshot after a batch's changes."""
    null = lambda *cols: [F.lit(None).cast(kind).alias(c) for c, kind in (x.rsplit(" ", 1) for x in cols)]
    cols = [c.split()[0] for c in _SNAPSHOT.split(", ")]
    part = lambda name: F.col("part") == name
    totals = snapshot.where(part("total")).select("kind", "id", "n", "pages", "last_seen").unionByName(
        changed.select("kind", "id", "n", F.col("fresh").cast("long").alias("pages"), F.to_timestamp_ntz("last_seen").alias("last_seen"))
    )
    totals = totals.groupBy("kind", "id").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.max("last_seen").alias("last_seen"))
    hits = changed.where("counts is not null")
    listed = snapshot.where(part("top")).select("kind", "id", "path", "n").unionByName(hits.select("kind", "id", "path", F.col("total").alias("n")))
    listed = listed.groupBy("kind", "id", "path").agg(F.max("n").alias("n"))
    listed = listed.withColumn("rank", F.row_number().over(W.partitionBy("kind", "id").orderBy(F.desc("n"), "path"))).where(F.col("rank") <= top)
    general = F.array(*[F.lit(f"crawler {c[1]}") for c in catalogue.CRAWLERS if not c[6]])
    weight = F.aggregate(F.map_values(F.map_filter(F.from_json("counts", "map<string, long>"), lambda k, n: ~F.array_contains(general, k))), F.lit(0).cast("long"), lambda a, n: a + n)
    pages = snapshot.where(part("page")).select("path", "n", "counts").unionByName(hits.select("path", weight.alias("n"), "counts")).where("n > 0")
    pages = pages.groupBy("path").agg(F.max(F.struct("n", "counts")).alias("p")).select("path", "p.n", "p.counts").orderBy(F.desc("n"), "path").limit(top)
    bad = changed.where("kind = 'file' and (id = 'damaged' or note is not null)").select("id", "path", F.col("note").alias("counts"))
    parts = [
        totals.select(F.lit("total").alias("part"), "kind", "id", *null("path string"), "n", "pages", "last_seen", *null("counts string")),
        listed.select(F.lit("top").alias("part"), "kind", "id", "path", "n", *null("pages long", "last_seen timestamp_ntz", "counts string")),
        pages.select(F.lit("page").alias("part"), *null("kind string", "id string"), "path", "n", *null("pages long", "last_seen timestamp_ntz"), "counts"),
        bad.select(F.lit("file").alias("part"), F.lit("file").alias("kind"), "id", "path", *null("n long", "pages long", "last_seen timestamp_ntz"), "counts"),
        snapshot.where(part("file")),
    ]
    return functools.reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])


def latest_snapshot(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The running report's last snapshot (of the batches before one)."""
    numbers = [k for k in _numbers(spark, folder, "snapshot") if before is None or k < before]
    return spark.read.schema(_SNAPSHOT).parquet(f"{folder}/snapshot={numbers[-1]}") if numbers else spark.createDataFrame([], _SNAPSHOT)


def report_of_snapshot(rows: DataFrame, top: int = TOP) -> report.Report:
    """The report from a snapshot; its files are the damaged ones and those of unknown format."""
    totals = rows.where("part = 'total'").select("kind", "id", "n", "pages", "last_seen")
    by_id = rows.where("part = 'top'").select("kind", "id", "path", "n")
    by_page = rows.where("part = 'page'").select("path", F.explode(F.from_json("counts", "map<string, long>")).alias("k", "n"))
    by_page = by_page.select(F.substring_index("k", " ", 1).alias("kind"), F.substring_index("k", " ", -1).alias("id"), "path", "n")
    files = rows.where("part = 'file'").select(F.col("path").alias("file"), (F.col("id") == "damaged").alias("damaged"), F.col("counts").alias("first"))
    return report.running_report(totals, by_id.unionByName(by_page).groupBy("kind", "id", "path").agg(F.max("n").alias("n")), files, top)


def _fold(changed: DataFrame, number: int, folder: str, on_batch: Callable[[report.Report], None], top: int = TOP) -> None:
    """Write the snapshot after a batch and hand over its report.

    All is named by the batch: one that runs again after a failure starts from the same snapshot and writes in the same place.
    """
    spark = changed.sparkSession
    changed = changed.persist()  # several parts of the snapshot read it
    try:
        _next(latest_snapshot(spark, folder, number), changed, top).coalesce(1).write.mode("overwrite").parquet(f"{folder}/snapshot={number}")  # as many rows as ids times top pages
    finally:
        changed.unpersist()
    rows = latest_snapshot(spark, folder, number + 1).persist()
    try:
        on_batch(report_of_snapshot(rows, top))
    finally:
        rows.unpersist()
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in _numbers(spark, folder, "snapshot")[:-KEPT]:
        files.delete(path(f"{folder}/snapshot={k}"), True)


def with_state(spark: SparkSession, start: Callable, partitions: int | None = None):
    """start() with the state store that keyed state needs; the query takes it with it, the session's own settings stay.

    A batch commits what it changed of the state, not the whole. ``partitions`` of the state stay as they are for the checkpoint's life; each
    costs every batch a store to open and a Python worker's turn, however little it holds. Unless given, they are spark.sql.shuffle.partitions.
    """
    own = {_PROVIDER: _ROCKS, _CHANGES: "true"} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_partitions(spark: SparkSession) -> int:
    """As many partitions of state as keep all cores at work; no more than shuffles have."""
    return min(int(spark.conf.get(_PARTITIONS)), 3 * spark.sparkContext.defaultParallelism)


def start_report(parsed: DataFrame, on_batch: Callable[[report.Report], None], checkpoint: str, own_host: str | None = None, top: int = TOP, partitions: int | None = None):
    """A query that, after each micro-batch of parsed lines, hands over the report of everything so far, with so many top pages; ``partitions`` as in with_state()."""
    folder = f"{checkpoint.rstrip('/')}/report"
    writer = running_changes(parsed, own_host).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return with_state(parsed.sparkSession, writer.foreachBatch(lambda changed, number: _fold(changed, number, folder, on_batch, top)).start, partitions)


def on_match(requests: DataFrame, callback: Callable[[dict], None], checkpoint: str, own_host: str | None = None):
    """A query that calls back for each match and logs a line; a callback that fails is logged and stops nothing.

    Calls come from the executors, once per row at least; use a picklable callback.
    """
    def each(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in rows:
            for r in df.to_dict("records"):
                try:
                    callback(r)
                except Exception:
                    _log.exception("callback failed for %s", r.get("line"))
            yield df[["line"]]

    def emit(batch: DataFrame, _: int) -> None:
        hits = tag(batch, own_host).where("ai_traffic is not null")
        flat = hits.select("ai_traffic.kind", "ai_traffic.id", "path", log_line(F.col("ai_traffic.kind"), F.col("ai_traffic.id"), F.col("path")).alias("line"))
        flat.mapInPandas(each, "line string").write.format("noop").mode("overwrite").save()

    return requests.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).start()


def announce(landed: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> list[str]:
    """Hand a batch of landings to every sink in order; a sink that fails doesn't keep the others from it. Returns the failures."""
    failures = []
    for sink in sinks:
        try:
            sink(landed)
        except Exception as err:
            _log.exception("sink failed")
            failures.append(repr(err))
    return failures


_VIEW = "session_id string, at long, seq long, source string, landing boolean"


def _attributed(idle: int):
    """Of a session, the views that the watermark has passed, in order of time; the others wait in the state with what is carried.

    The state wakes when the watermark reaches its first waiting view or, if none waits, when the session has been idle so
    long that it has ended; then it goes.
    """
    columns = [c.split()[0] for c in _VIEW.split(", ")]

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, last, held = state.get if state.exists else (None, None, "[]")
        waiting = json.loads(held)
        for df in rows:
            own = [x if isinstance(x, str) else None for x in df["own"].tolist()]
            waiting += [list(r) for r in zip(df["at"].tolist(), df["seq"].tolist(), own, df["again"].tolist())]
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        waiting.sort(key=lambda r: (r[0], r[1]))
        ready = [r for r in waiting if r[0] < mark]
        for ts, seq, own, again in ready:
            if last is not None and ts - last > idle:
                source = None
            source, last = own or source, ts
            out.append((key[0], ts, seq, source, None if source is None else own is not None and not again))
        waiting = waiting[len(ready) :]
        wake = waiting[0][0] if waiting else (last or 0) + idle
        if not waiting and wake < mark:
            state.remove()
        else:
            state.update((source, last, json.dumps(waiting)))
            state.setTimeoutTimestamp(max(wake // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame({c: pd.Series(v, dtype=object if c in ("source", "landing") else None) for c, v in zip(columns, zip(*out))})

    return run


def attribute_stream(views: DataFrame, idle_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """The batch attribution (with the same idle_minutes) over a stream of views(session_id, ts, seq, referrer, hostname, nav_type).

    Views may come as late as ``late`` says; each is given out once that time has passed it, so those that come out of
    order are attributed by their times. Start the query through with_state(), or with a state store that fits its keys.
    """
    from botledger.operators.classify import referral_id

    timed = views.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    again = F.coalesce(F.col("nav_type").isin(*sessions.REVISITS), F.lit(False))
    own = timed.select("session_id", "ts", F.unix_micros("ts").alias("at"), "seq", again.alias("again"), referral_id(F.col("referrer"), F.col("hostname")).alias("own"))
    out = own.groupBy("session_id").applyInPandasWithState(
        _attributed(idle_minutes * 60_000_000), _VIEW, "source string, last long, waiting string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select("session_id", F.timestamp_micros("at").alias("ts"), "seq", "source", sessions.vendor_of(F.col("source")).alias("vendor"), "landing")
