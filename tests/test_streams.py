"""Streaming queries give what the batch gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from botledger.operators import sessions
from botledger.streaming import live

LINE = '198.51.100.7 - - [03/Mar/2026:10:00:0{n} +0000] "GET /p{n} HTTP/1.1" 200 5 "{ref}" "{ua}"'


def test_running_report(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.log").write_text("\n".join(LINE.format(n=n % 3, ref="-", ua="GPTBot") for n in range(6)) + "\nbroken\n")
    (folder / "2.log").write_text(LINE.format(n=5, ref="https://claude.ai/", ua="Mozilla") + "\n")
    (folder / "3.log").write_text(LINE.format(n=1, ref="-", ua="GPTBot") + "\n" + LINE.format(n=7, ref="-", ua="x") + "\nno\n")
    seen = []
    stream = live.parsed_stream(spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(folder)), "combined")
    q = live.start_report(stream, lambda rep: seen.append((rep.crawlers.collect(), rep.referrals.collect(), rep.summary.first().asDict())), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    crawlers, referrals, summary = seen[-1]
    assert len(seen) == 3
    assert [(r["id"], r["requests"], r["unique_pages"]) for r in crawlers] == [("openai-gptbot", 7, 3)]
    assert [(r["id"], r["visits"]) for r in referrals] == [("claude", 1)]
    assert summary == {"records": 9, "skipped": 2, "ai_crawler_requests": 7, "ai_referral_visits": 1}
    assert seen[0][2]["records"] < 9


def test_stream_of_log_files(spark, tmp_path):
    """Files of all formats come in one after another, gzip without a name for it among them; the running report is the batch report."""
    import gzip

    from botledger.plans.engine import Engine

    folder = tmp_path / "in"
    folder.mkdir()
    fields = "#Version: 1.0\n#Fields: date time cs-uri-stem sc-status cs(Referer) cs(User-Agent)\n"
    cloudfront = fields + "2026-03-03\t09:00:00\t/caf%C3%A9\t200\thttps://claude.ai/\tMozilla%20x\n#Fields: sc-status date time cs-uri-stem cs(User-Agent) cs(Referer)\n404\t2026-03-03\t09:00:01\t/b\tGPTBot\t-\n"
    alb = 'h2 2026-03-03T09:30:00.999999Z app/x 1.2.3.4:5 10.0.0.1:80 0 0 0 200 200 1 2 "GET https://h.example:443/a HTTP/2.0" "gptbot" x y\n'
    seen = []
    q = live.start_report(live.log_stream(spark, str(folder), str(tmp_path / "ledger")), lambda rep: seen.append(rep.to_dict()), str(tmp_path / "cp"))
    for name, data in (("c", gzip.compress(cloudfront.encode())), ("a", alb.encode()), ("n", (LINE.format(n=1, ref="-", ua="ClaudeBot") + "\nbroken\n").encode())):
        (folder / name).write_bytes(data)
        q.processAllAvailable()
    q.stop()
    assert seen[-1] == Engine(spark).report(str(folder)).to_dict()
    assert seen[-1]["summary"] == {"records": 4, "skipped": 1, "ai_crawler_requests": 3, "ai_referral_visits": 1}


def test_running_report_survives_batches_that_run_again(spark, tmp_path):
    gptbot = ("crawler", "openai-gptbot")
    batches = [[("/a", 1), ("/b", 1)], [("/a", 3)], [("/c", 1)], [("/b", 2), ("/d", 1)], [("/a", 4)]]
    was: dict = {}
    folder, seen = str(tmp_path / "report"), []
    for number, rows in enumerate(batches):
        changed = [(*gptbot, p, None, n - was.get(p, 0), p not in was, n, "2026-01-01 00:00:00", json.dumps({"crawler openai-gptbot": n})) for p, n in rows]
        for _ in range(2):  # as after a failure before the batch was committed
            live._fold(spark.createDataFrame(changed, live._CHANGE), number, folder, lambda rep: seen.append((rep.crawlers.first()[6:8], {r["path"]: r["n"] for r in rep.crawler_pages.collect()}, rep.pages.first()[0])))
        was |= dict(rows)
        assert seen[-1] == seen[-2] == ((sum(was.values()), len(was)), was, min(was, key=lambda p: (-was[p], p)))
    assert live._numbers(spark, folder, "snapshot") == [2, 3, 4]


def test_running_report_does_not_grow_with_its_history(spark, tmp_path):
    """Over fifty batches: each reads and writes the states of its own paths, and a snapshot that stays as small; at the end the report is the batch's."""
    from botledger.plans.engine import Engine

    folder, sizes, rng = tmp_path / "in", [], random.Random(3)
    folder.mkdir()
    agents = ["GPTBot", "ClaudeBot", "Googlebot", "x"]
    line = '198.51.100.7 - - [03/Mar/2026:10:{m:02d}:00 +0000] "GET /p{n} HTTP/1.1" 200 5 "{ref}" "{ua}"\n'
    for k in range(50):
        text = "".join(line.format(m=k, n=int(rng.paretovariate(0.4)) % 400 + 400 * (k % 2) * (rng.random() < 0.5), ref=rng.choice(["-", "https://claude.ai/", "https://chatgpt.com/"]), ua=rng.choice(agents)) for _ in range(60))
        (folder / f"{k:02d}.log").write_text(text + "broken\n")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        reports = []
        rows = live.log_stream(spark, str(folder), str(tmp_path / "book"), max_files=1)
        def on_batch(rep):
            sizes.append(sum(f.stat().st_size for f in (tmp_path / "state" / "report").rglob("*.parquet")))
            if len(sizes) in (25, 50):
                reports.append(rep.to_dict())
        q = live.start_report(rows, on_batch, str(tmp_path / "state"))
        q.processAllAvailable()
        updated = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
        q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(sizes) == 50 == len(updated) and max(updated) <= 60
    assert max(sizes[40:]) < 1.3 * max(sizes[10:20])
    for n, got in zip((25, 50), reports):
        want = Engine(spark).report([str(folder / f"{k:02d}.log") for k in range(n)])
        assert got == want.to_dict()
        want.release()


def test_tags_and_callbacks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.log").write_text(LINE.format(n=1, ref="-", ua="ClaudeBot") + "\n" + LINE.format(n=2, ref="-", ua="x") + "\n")
    out = tmp_path / "calls"

    def callback(match):
        with open(out, "a") as f:
            f.write(match["line"] + "\n")
        raise RuntimeError("a failing callback stops nothing")

    q = live.on_match(live.parse_stream(spark.readStream.format("text").load(str(folder)), "combined"), callback, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert out.read_text() == "ai_traffic kind=crawler id=anthropic-claudebot path=/p1\n"


def test_header_values(spark):
    df = spark.sql("SELECT array(struct(X'486f7374' AS name, X'61' AS value), struct(X'484f5354' AS name, X'e9' AS value)) AS h")
    assert df.select(live.header_value(F.col("h"), "host"), live.header_value(F.col("h"), "x")).first() == ("é", "")


def test_announce_goes_on_after_a_failure(spark):
    calls = []

    def bad(_):
        raise RuntimeError("no")

    assert len(live.announce(spark.range(1), [bad, lambda df: calls.append(df.count())])) == 1
    assert calls == [1]


def views(spark):
    rows = [
        ("s1", "2026-01-01 00:00:00", 1, "https://claude.ai/", "x.example", "navigate"), ("s1", "2026-01-01 00:01:00", 2, "", "x.example", "navigate"),
        ("s1", "2026-01-01 00:02:00", 3, "https://claude.ai/", "x.example", "reload"), ("s1", "2026-01-01 00:03:00", 4, "https://chatgpt.com/", "x.example", "navigate"),
        ("s2", "2026-01-01 00:00:00", 5, "https://chatgpt.com/", "chatgpt.com", "navigate"), ("s2", "2026-01-01 00:01:00", 6, "", "x.example", None),
    ]
    df = spark.createDataFrame(rows, "session_id string, ts string, seq long, referrer string, hostname string, nav_type string")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_sessions(spark):
    out = {r["seq"]: (r["source"], r["vendor"], r["landing"]) for r in sessions.attribute(views(spark)).collect()}
    assert out == {
        1: ("claude", "anthropic", True), 2: ("claude", "anthropic", False), 3: ("claude", "anthropic", False), 4: ("chatgpt", "openai", True), 5: (None, None, None), 6: (None, None, None)
    }


def rows_of(df):
    return sorted((r["seq"], r["source"], r["vendor"], r["landing"]) for r in df.collect() if r["seq"] is not None)


def test_sessions_over_a_stream(spark, tmp_path):
    """Views come out of order and late; sessions end when idle, and their state goes once time has passed them."""
    made = views(spark).withColumn("ts", F.col("ts") + F.when(F.col("seq") == 4, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS")))
    more = spark.createDataFrame(
        [("s1", "2026-01-01 02:10:00", 7, "", "x.example", "navigate"), ("s1", "2026-01-01 06:00:00", 8, "", "x.example", "navigate"), ("s3", "2026-01-01 00:30:00", 9, "https://claude.ai/", "x.example", None)],
        "session_id string, ts string, seq long, referrer string, hostname string, nav_type string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    every, path, out = made.unionByName(more), tmp_path / "in", str(tmp_path / "out")
    path.mkdir()
    stream = live.attribute_stream(spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(path)), 60, late="3 hours")
    q = live.with_state(spark, stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start)
    states = []
    for seqs in ([2, 5], [1, 9], [6, 3], [7], [4], [8], [1000], [1001]):  # each later one at most three hours behind
        for seq in seqs:
            end = spark.createDataFrame([(f"end{seq}", f"2026-01-0{seq - 998} 00:00:00", None, "", "", None)], "session_id string, ts string, seq long, referrer string, hostname string, nav_type string") if seq >= 1000 else None
            (every.where(F.col("seq") == seq) if end is None else end.withColumn("ts", F.col("ts").cast("timestamp"))).coalesce(1).write.mode("append").parquet(str(path))
        q.processAllAvailable()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    assert rows_of(spark.read.parquet(out)) == rows_of(sessions.attribute(every, 60))
    got = {r[0]: r[1:] for r in rows_of(sessions.attribute(every, 60))}
    assert got[7] == ("chatgpt", "openai", False) and got[8] == (None, None, None)
    assert max(states) >= 3 and states[-1] <= 1  # only what came last is still there


def test_idle_sessions_in_batch(spark):
    assert rows_of(sessions.attribute(views(spark), 2)) == rows_of(sessions.attribute(views(spark)))
    cut = {r[0]: r[1] for r in rows_of(sessions.attribute(views(spark).withColumn("ts", F.col("ts") + F.expr("make_dt_interval(0, 0, cast(seq * 10 as int))")), 10))}
    assert cut[2] is None and cut[1] == "claude" and cut[4] == "chatgpt"


EVENT = "seq long, text string"


def test_outbox_has_each_event_once(spark, tmp_path):
    """Batches that are written twice, fail half-way, or leave files behind; rows of empty tasks; columns of all kinds."""
    from botledger.streaming import outbox

    folder = str(tmp_path / "box")
    rows = spark.range(100).select(F.col("id").alias("seq"), F.concat(F.lit("é\n"), F.col("id")).alias("text"), F.current_timestamp().alias("at"), F.array(F.lit(1)).alias("list")).repartition(7)
    outbox.post(rows, folder, batch="a")
    outbox.post(rows, folder, batch="a")

    @F.udf("string")
    def breaks(text):
        if text.endswith("77"):
            raise RuntimeError("half-way")
        return text

    with pytest.raises(Exception, match="half-way"):
        outbox.post(rows.select("seq", breaks("text").alias("text")).repartition(7), folder, batch="b")
    assert outbox.batches(folder) == ["a"]
    outbox.post(rows.where("seq < 5"), folder, batch="b")
    outbox.post(rows.where("false"), folder, batch="c")
    got = outbox.read(spark, folder, EVENT)
    assert sorted((r["batch"], r["seq"]) for r in got.collect()) == [("a", k) for k in range(100)] + [("b", k) for k in range(5)]
    assert {r["text"] for r in got.where("seq = 3").collect()} == {"é\n3"}
    assert outbox.batches(folder, after="a") == ["b", "c"] and outbox.read(spark, folder, EVENT, after="b").count() == 0
    assert outbox.read(spark, str(tmp_path / "none"), EVENT).count() == 0


def test_outbox_of_a_stream_that_fails_half_way(spark, tmp_path):
    from botledger.streaming import outbox

    folder, mark = tmp_path / "in", tmp_path / "failed"
    spark.range(40).repartition(4).write.json(str(folder))

    def once(batches):
        for df in batches:
            if (df["id"] == 33).any() and not mark.exists():
                mark.write_text("x")
                raise RuntimeError("half-way")
            yield df

    def start():
        came = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).json(str(folder)).mapInPandas(once, "id long")
        return outbox.post_stream(came.selectExpr("id as seq", "'x' as text"), str(tmp_path / "box"), str(tmp_path / "cp"))

    q = start()
    with pytest.raises(Exception, match="half-way"):
        q.processAllAvailable()
    q.stop()
    q = start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["seq"] for r in outbox.read(spark, str(tmp_path / "box"), EVENT).collect()) == list(range(40))
    assert len(outbox.batches(str(tmp_path / "box"))) == 2


def test_state_has_as_many_partitions_as_keep_cores_at_work(spark):
    names = (live._PARTITIONS, live._CHANGES, live._PROVIDER)
    get = lambda: [spark.conf.get(n, None) for n in names]
    before = get()
    assert live.with_state(spark, get, 5) == ["5", "true", live._ROCKS] and live.with_state(spark, get)[0] == before[0]
    assert get() == before
    spark.conf.set(live._PARTITIONS, "2000")
    try:
        assert live.state_partitions(spark) == 3 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(live._PARTITIONS, before[0])
    assert live.state_partitions(spark) == int(before[0]) <= 3 * spark.sparkContext.defaultParallelism
