"""Readers, reports, command line and hostile input on files written here."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from botledger import cli
from botledger.operators import lines, report
from botledger.plans.engine import Engine, page_view
from botledger.sources import catalogue
from botledger.sources.logfiles import UnknownFormatError

LINE = b'198.51.100.7 - - [03/Mar/2026:10:00:00 +0100] "GET /a?x=1 HTTP/1.1" 200 5 "-" "GPTBot/1.1"\n'


@pytest.fixture()
def engine(spark):
    return Engine(spark)


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data)
    return str(path)


def stats(engine, path):
    r = engine.file_stats(path).first()
    return r["fmt"], r["lines"], r["records"], r["skipped"], r["truncated"]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (LINE[:-1] + b"\r" + LINE[:-1] + b"\r\n \n" + LINE[:-1], ("combined", 4, 3, 0, False)),
        (gzip.compress(LINE) + gzip.compress(LINE) + b"\0" * 40, ("combined", 2, 2, 0, False)),
        (gzip.compress(LINE) + b"trailing", ("combined", 1, 1, 0, True)),
        (b"\xef\xbb\xbf" + LINE, ("combined", 1, 1, 0, False)),
        (LINE + b"broken\n" + LINE.replace(b"GPTBot", b"\xff\xfe"), ("combined", 3, 2, 1, False)),
        (b"", (None, 0, 0, 0, False)),
    ],
)
def test_reading(engine, tmp_path, data, want):
    assert stats(engine, put(tmp_path, "x.bin", data)) == want


def test_half_a_gzip_keeps_complete_lines(engine, tmp_path):
    whole = gzip.compress(b"".join(LINE.replace(b"/a", b"/%d" % (i * 7919 % 99991)) for i in range(5000)))
    _, n, records, skipped, truncated = stats(engine, put(tmp_path, "half.log", whole[: len(whole) // 2]))
    assert truncated and 0 < n == records < 5000 and skipped == 0


def test_ranges_read_each_line_once(engine, tmp_path):
    path = put(tmp_path, "big.log", b"".join(LINE.replace(b"/a", b"/%d" % i) for i in range(2000)))
    df = engine.lines(path, split=True, splitBytes=4999).where("line_no is not null")
    assert df.count() == 2000 == df.select("line").distinct().count() == df.select("line_no").distinct().count()
    ordered = [r["line"] for r in df.orderBy("line_no").collect()]
    assert ordered == [r["line"] for r in engine.lines(path).where("line_no is not null").orderBy("line_no").collect()]


def test_files_in_a_store(spark, engine, tmp_path):
    """Addresses that only Spark opens give what local paths give."""
    put(tmp_path, "a.log", LINE * 3 + b"broken\n")
    put(tmp_path, "b.log", gzip.compress(LINE * 500)[:-30])
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_path}")
    for name in ("a.log", "b.log"):
        assert engine.file_stats(f"viewfs://logs/in/{name}").drop("file").first() == engine.file_stats(str(tmp_path / name)).drop("file").first()
    assert engine.report("viewfs://logs/in/a.log").to_dict()["crawlers"][0]["requests"] == 3


def test_unknown_format_names_the_line(engine, tmp_path):
    with pytest.raises(UnknownFormatError, match="what is this"):
        engine.parse(put(tmp_path, "u.log", b"\nwhat is this\n"))
    with pytest.raises(UnknownFormatError):
        engine.parse(put(tmp_path, "bom.log", b"\xef\xbb\xbf#Version: 1.0\n"))


def events_from(spark, sf_dir, folder, first):
    """A folder of tables whose events begin with one, most others left out."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.where("event_id < 400").withColumn("event_id", F.col("event_id") + first).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def query_and_oracle(spark, folder, name):
    import duckdb

    from botledger.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    frame = QUERIES[name](spark, folder)
    cols = ", ".join(frame.columns)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    return order(frame.collect()), order(con.execute(f"SELECT {cols} FROM ({ORACLE[name]})").fetchall())


@pytest.mark.parametrize("name", ["pasted_text", "mixed_formats"])
def test_texts_that_begin_with_a_broken_line(spark, sf_dir, tmp_path, name):
    """Event 521,000 is broken and the first of its text and, here, of its file."""
    folder = events_from(spark, sf_dir, tmp_path, 521_000 if name == "pasted_text" else 13)
    if name == "mixed_formats":  # the first of the file log0, too
        spark.read.parquet(f"{folder}/events.parquet").withColumn("user_id", F.when(F.col("event_id") < 15, 4).otherwise(F.col("user_id"))).coalesce(1).write.parquet(f"{folder}/b/events.parquet")
        folder += "/b"
    got, want = query_and_oracle(spark, folder, name)
    assert got == want


@pytest.mark.parametrize("name", ["read_records", "read_files", "read_report"])
def test_files_that_begin_with_a_broken_line(spark, sf_dir, tmp_path, name):
    """Each of the files but CloudFront's begins with a broken line."""
    folder = events_from(spark, sf_dir, tmp_path, 13)
    turned = F.when(F.col("event_id") < 310, F.floor(F.col("event_id") / 97)).otherwise(F.col("user_id"))
    rows = spark.read.parquet(f"{folder}/events.parquet").withColumn("user_id", turned).where("user_id % 4 <> 2 or event_id > 400")
    rows.where("event_id % 97 = 13 or event_id > 310").coalesce(1).write.parquet(f"{folder}/b/events.parquet")
    got, want = query_and_oracle(spark, f"{folder}/b", name)
    assert got == want


def test_lenient_formats(engine, tmp_path):
    """The first line that fits shows the format, in files read whole or in parts; a file without one has malformed lines only."""
    data = b"broken\n \nbroken, too\n" + LINE * 300
    for name, content in (("plain", data), ("packed", gzip.compress(data)), ("members", gzip.compress(data[:40]) + gzip.compress(data[40:]))):
        path = put(tmp_path, name, content)
        for options in ({}, {"split": True, "splitBytes": 5_000}):
            assert engine.file_stats(path, lenient=True, **options).select("fmt", "lines", "records", "skipped").first() == ("combined", 303, 300, 2)
        with pytest.raises(UnknownFormatError, match="broken"):
            engine.parse(path)
    none = put(tmp_path, "none", b"broken\nbroken\n")
    assert engine.file_stats(none, lenient=True).select("fmt", "lines", "records", "skipped").first() == (None, 2, 0, 2)
    assert engine.parse(none, lenient=True).select("outcome").distinct().collect() == [("malformed",)]
    assert engine.report([none, str(tmp_path / "plain")], lenient=True).to_dict()["summary"]["records"] == 300


def test_report_of_mixed_files(engine, tmp_path):
    alb = b'h2 2026-03-03T09:30:00.999999Z app/x 1.2.3.4:5 10.0.0.1:80 0 0 0 200 200 1 2 "GET https://h.example:443/a HTTP/2.0" "gptbot" x y\n'
    cf = (
        b"#Version: 1.0\n#Fields: date time cs-uri-stem sc-status cs(Referer) cs(User-Agent)\n2026-03-03\t09:00:00\t/caf%C3%A9\t200\thttps://claude.ai/\tMozilla%20x\n"
        b"#Fields: date time\n2026-03-03\t09:00:01\t/b\t404\t-\tGooglebot\n"
    )
    paths = [put(tmp_path, "a.log", LINE * 2), put(tmp_path, "b.log", alb), put(tmp_path, "c.log", gzip.compress(cf))]
    rep = engine.report(paths)
    data = rep.to_dict()
    assert data["summary"] == {"records": 5, "skipped": 1, "ai_crawler_requests": 3, "ai_referral_visits": 1}
    first = data["crawlers"][0]
    assert (first["id"], first["requests"], first["last_seen"], first["top_pages"]) == ("openai-gptbot", 3, "2026-03-03T09:30:00+00:00", [{"path": "/a", "count": 3}])
    assert [p["path"] for p in data["pages"]] == ["/a", "/café"]
    view = page_view(rep)
    assert [r["token"] for r in view["search_engines"].collect()] == ["Googlebot"]
    assert engine.report(paths, own_host="www.claude.ai").to_dict()["referrals"] == []
    assert engine.report(paths, since="2026-03-03T09:30:00Z").to_dict()["crawlers"][0]["requests"] == 1


def test_report_reads_each_file_once(engine, tmp_path):
    """All frames of a report come from one scan, parsed without moving a line; long plain files are read in ranges."""
    big = put(tmp_path, "big.log", b"".join(LINE.replace(b"/a", b"/%d" % (i % 50)) for i in range(3000)) + b"broken\n")
    rep = engine.report([big, put(tmp_path, "g.log", gzip.compress(LINE * 10)[:-12])], splitBytes=20_000)
    initial = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert initial(rep.tally).count("BatchScan") == 1 == initial(rep.tally).count("Exchange") and "SortAggregate" not in initial(rep.tally)
    for frame in (rep.summary, rep.crawlers, rep.referrals, rep.pages, rep.crawler_pages, rep.referral_pages, rep.files):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in text and initial(frame).count("BatchScan") == 1
    assert engine.lines(big, split=True, splitBytes=20_000).rdd.getNumPartitions() > 10
    data = rep.to_dict()
    assert data["summary"]["records"] >= 3000 and data["summary"]["skipped"] == 1 and data["crawlers"][0]["unique_pages"] >= 50
    assert [r["damaged"] for r in rep.files.orderBy("file").collect()] == [False, True]
    rep.release()


def test_ranges_agree_with_whole_files(engine, tmp_path):
    """CRLF, invalid bytes and a missing last line end give the same report in ranges; CloudFront and CR files stay whole."""
    rows = b"".join(LINE.replace(b"/a", b"/%d" % (i % 9)).replace(b"\n", [b"\n", b"\r\n"][i % 2]).replace(b"GPTBot", [b"GPTBot", b"\xe2\x82"][i % 5 == 0]) for i in range(500))
    path = put(tmp_path, "m.log", rows + LINE[:-1])
    cr = put(tmp_path, "cr.log", LINE.replace(b"\n", b"\r") * 400)
    for p in (path, cr):
        whole, parts = (engine.report(p, split=s, splitBytes=1000).to_dict() for s in (False, True))
        assert whole == parts and whole["summary"]["skipped"] == 0
    assert engine.lines(cr, split=True, splitBytes=1000).rdd.getNumPartitions() == 1


def test_empty_log(engine, tmp_path):
    data = engine.report(put(tmp_path, "e.log", b"\n")).to_dict()
    assert data["summary"]["records"] == 0 and data["crawlers"] == data["referrals"] == data["pages"] == []


@pytest.mark.parametrize("text", ["30m", "24h", "7D", "2w", "2026-01-02", "2026-01-02T03:04:05+02:00", "2026-01-02T03:04:05z"])
def test_since_is_read(text):
    assert report.parse_since(text).tzinfo is not None


@pytest.mark.parametrize("text", ["yesterday", "7", "d7", ""])
def test_since_is_refused(text):
    with pytest.raises(ValueError):
        report.parse_since(text)


def test_hostile_lines_cost_little(spark, engine):
    start = '198.51.100.7 - - [03/Mar/2026:10:00:00 +0000] "GET / HTTP/1.1" 200 5 "'
    began = time.time()
    assert [r["outcome"] for r in engine.parse_text(start + '\\"' * 50_000 + "\n", "combined").collect()] == ["malformed"]
    long_host = "https://" + "a." * 20_000 + "com/"
    assert engine.check(long_host).first()["match"] is None
    assert time.time() - began < 20


def test_progress_and_abort(spark, engine, tmp_path):
    import threading

    from botledger.plans.watch import Aborted

    path, seen = put(tmp_path, "p.log", LINE * 2000), []
    data = engine.watch(lambda: engine.report(path, splitBytes=10_000).to_dict(), lambda done, planned: seen.append((done, planned)))
    assert data["summary"]["records"] == 2000 and seen[-1][0] == seen[-1][1] > 0 and all(d <= n for d, n in seen)
    stop = threading.Event()
    slow = lambda: spark.range(8, numPartitions=8).mapInPandas(lambda it: (__import__("time").sleep(60) or x for x in it), "id long").count()
    threading.Timer(2, stop.set).start()
    began = time.time()
    with pytest.raises(Aborted):
        engine.watch(slow, abort=stop)
    assert time.time() - began < 40
    with pytest.raises(ZeroDivisionError):
        engine.watch(lambda: 1 // 0)


def test_catalogue_is_sound():
    assert catalogue.problems() == []
    twice = [*catalogue.CRAWLERS, catalogue.CRAWLERS[0]]
    assert catalogue.problems(twice) == [f"crawler id {catalogue.CRAWLERS[0][1]!r} occurs twice"]


def test_catalogue_file(spark, tmp_path, engine):
    path = tmp_path / "signals.json"
    data = catalogue.dump()
    path.write_text(json.dumps(data))
    assert catalogue.load(str(path)) == (catalogue.CRAWLERS, catalogue.REFERRERS)
    for change, says in (
        ({"schema_version": 2}, "schema version"), ({"crawlers": [data["crawlers"][0] | {"match": "guess"}]}, "unknown match"), ({"crawlers": [data["crawlers"][0] | {"ai_specific": "yes"}]}, "ai_specific"),
        ({"crawlers": [{k: v for k, v in data["crawlers"][0].items() if k != "token"}]}, "no 'token'"), ({"referrers": data["referrers"][:1] * 2}, "occurs twice"),
        ({"crawlers": [data["crawlers"][0] | {"added": "soon"}]}, "not a date"),
    ):
        path.write_text(json.dumps(data | change))
        with pytest.raises(ValueError, match=says):
            catalogue.load(str(path))
    was = list(catalogue.CRAWLERS), list(catalogue.REFERRERS)
    path.write_text(json.dumps(data | {"crawlers": [data["crawlers"][0] | {"id": "x-own", "token": "OwnBot", "added": "2027-01-02"}]}))
    try:
        catalogue.install(str(path))
        assert engine.check("an ownbot/1").first()["match"]["id"] == "x-own" and engine.check("GPTBot").first()["match"] is None
        assert [(r["token"], r["added"]) for r in engine.crawlers().collect()] == [("OwnBot", "2027-01-02")]
    finally:
        catalogue.CRAWLERS[:], catalogue.REFERRERS[:] = was


def test_check(engine):
    row = engine.check("Mozilla/5.0 claudebot").first()
    assert row["match"]["id"] == "anthropic-claudebot" and row["match"]["kind"] == "crawler"
    assert engine.check("https://www.perplexity.ai/x").first()["match"]["product"] == "Perplexity"
    assert engine.check("perplexity.ai").first()["did_you_mean"] == "https://perplexity.ai/"


def test_command_line(spark, tmp_path, capsys):
    good, half = put(tmp_path, "g.log", LINE), put(tmp_path, "h.log", gzip.compress(LINE * 500)[:-30])
    assert cli.main(["parse", good, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["records"] == 1
    assert cli.main(["parse", good]) == 0
    assert "GPTBot" in capsys.readouterr().out
    assert cli.main(["parse", half]) == 1
    assert cli.main(["parse", str(tmp_path / "no.log")]) == 2
    assert cli.main(["parse", good, "--top", "0"]) == 2
    assert cli.main(["check", "GPTBot"]) == 0
    assert cli.main(["check", "chatgpt.com"]) == 1


def test_robots_of_one_file(engine):
    text = "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /*.pdf$\nAllow: /$\n"
    rows = {r["token"]: r for r in engine.robots(text).collect()}
    assert len(rows) == 28
    assert (rows["GPTBot"]["verdict"], rows["GPTBot"]["source"], [tuple(x) for x in rows["GPTBot"]["lines"]]) == ("blocked", "token", [(1, "User-agent: GPTBot"), (2, "Disallow: /")])
    assert (rows["ClaudeBot"]["verdict"], rows["ClaudeBot"]["source"]) == ("partial", "star")
    assert {r["verdict"] for r in engine.robots(None).collect()} == {"allowed"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Allow: /$\nDisallow: /", "partial"), ("Disallow: /*\nAllow: /$", "partial"), ("Disallow: /docs\nAllow: /docs$", "partial"), ("Disallow: /\nAllow: /", "allowed"),
        ("Disallow: /docs\nAllow: /docs/", "partial"), ("Disallow:", "allowed"), ("Disallow: /a\nAllow: /a\nDisallow: /a/b", "partial"), ("Disallow: " + "*a" * 200 + "$", "partial"),
    ],
)
def test_robots_verdicts(engine, text, want):
    assert engine.robots("User-agent: *\n" + text).where("token = 'ClaudeBot'").first()["verdict"] == want


def test_report_reads_only_what_it_needs(spark, sf_dir):
    from botledger import queries

    plan = queries.QUERIES["report_crawlers"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_lines_of_other_formats_are_refused(spark):
    with pytest.raises(ValueError):
        lines.parse_lines(spark.createDataFrame([("f", 1, "x")], "file string, line_no long, line string"), "iis")
