"""Streams read each file once, in whatever order files come; plans of many files are small and open none."""

import gzip
import os

import pytest

from botledger.plans.engine import Engine
from botledger.sources import arrivals, logfiles, splits, stores
from botledger.streaming import live

LINE = '198.51.100.7 - - [03/Mar/2026:10:00:00 +0000] "GET /p{n} HTTP/1.1" 200 5 "-" "GPTBot"\n'


def come(folder, name, text, time):
    """A file moved in, with the time of its last change as it was before."""
    path = folder.parent / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (time, time))
    os.rename(path, folder / name)
    return str(folder / name)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def names(found):
    return [os.path.basename(f.path) for f in found]


def test_ledger_numbers_what_comes(folder, tmp_path):
    book = lambda most=0: arrivals.Ledger(str(tmp_path / "book"), [str(folder)], most)
    b = book()
    assert b.look() == 0
    come(folder, "b", "2", 2_000)
    assert (b.look(), b.look()) == (1, 1)
    come(folder, "a", "1", 1_000)  # an older time than the last
    come(folder, "c", "3", 2_000)  # an equal one
    come(folder, ".hidden", "x", 5_000)
    assert b.look() == 2 and names(b.between(0, 1)) == ["b"] and names(b.between(1, 2)) == ["a", "c"]
    again = book()  # a query that starts again
    assert again.last == 2 and again.look() == 2 and again.between(0, 2) == b.between(0, 2)
    come(folder, "a", "other", 1_000)  # a file in place of an old one
    assert again.look() == 3 and [f.size for f in again.between(2, 3)] == [5]
    for k in range(5):
        come(folder, f"d{k}", "x", 3_000 - k)
    few = book(2)
    assert [few.look() for _ in range(4)] == [4, 5, 6, 6] and [names(few.entry(k)) for k in (4, 5, 6)] == [["d4", "d3"], ["d2", "d1"], ["d0"]]


def test_ledger_folds_and_forgets(folder, tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "FOLD", 4)
    monkeypatch.setattr(arrivals, "KEEP", 6)
    now = [1_000_000.0]
    book = lambda: arrivals.Ledger(str(tmp_path / "book"), [str(folder)], 0, clock=lambda: now[0])
    b, last = book(), {}
    for k in range(20):
        last[k] = come(folder, f"f{k}", "x" * k, 5_000 - k)
        number = b.look()
        b.done(number - 1)
        now[0] += 3_600
    kept = sorted(os.listdir(tmp_path / "book"))
    assert [n for n in kept if n.startswith("seen")] == ["seen-000000000016.json"] and kept[0] == "entry-000000000011.json"
    assert book().look() == 20  # nothing is new to a query that starts again
    os.remove(last[3])
    now[0] += 3 * 86_400
    c = book()
    c.look()
    come(folder, "f3", "xxx", 5_000 - 3)  # back within the time that files are remembered
    assert c.look() == 20
    os.remove(last[5])
    now[0] += 30 * 86_400
    c.look()
    come(folder, "new", "n", 1)
    for number in range(21, 29):
        come(folder, f"n{number}", "n", number)
        c.done(c.look())
    assert "f5" not in names(c.seen) and "f3" in names(c.seen)


def test_stream_reads_late_files_once_and_survives_failures(spark, folder, tmp_path):
    seen, fail = [], [True]

    def start():
        def on_batch(rep):
            if fail[0] and len(seen) == 1:
                fail[0] = False
                raise RuntimeError("a batch that fails once")
            seen.append({r["path"]: r["n"] for r in rep.crawler_pages.collect()})

        rows = live.log_stream(spark, str(folder), str(tmp_path / "book"), max_files=2)
        return live.start_report(rows, on_batch, str(tmp_path / "state"))

    come(folder, "m.log", LINE.format(n=1), 9_000)
    q = start()
    q.processAllAvailable()
    come(folder, "late.log", LINE.format(n=2) * 2, 1_000)  # long before the last one
    come(folder, "same.log", gzip.compress(LINE.format(n=3).encode()), 9_000)
    come(folder, "new.log", LINE.format(n=1), 10_000)
    with pytest.raises(Exception, match="fails once"):
        q.processAllAvailable()
    q.stop()
    come(folder, "older.log", LINE.format(n=4), 10)
    q = start()
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == {"/p1": 2, "/p2": 2, "/p3": 1, "/p4": 1}
    assert len(seen) >= 3  # two files a batch
    want = Engine(spark).report(str(folder))
    assert {r["path"]: r["n"] for r in want.crawler_pages.collect()} == seen[-1]
    want.release()


def test_stream_of_a_store_that_only_spark_opens(spark, folder, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.arrive.link./in", f"file://{folder}")
    seen = []
    q = live.start_report(live.log_stream(spark, "viewfs://arrive/in", str(tmp_path / "book")), lambda rep: seen.append(rep.summary.first()["records"]), str(tmp_path / "state"))
    for name, time in (("b", 9_000), ("a", 1_000)):
        come(folder, name, LINE.format(n=1) * 3, time)
        q.processAllAvailable()
    q.stop()
    assert seen == [3, 6]


def test_many_small_files_are_few_tasks_and_none_is_opened_to_plan(spark, folder, monkeypatch):
    for n in range(20_000):
        (folder / f"{n:05d}.log").write_text(LINE.format(n=n % 7))
    opened = []
    monkeypatch.setattr(stores, "open_file", lambda path: opened.append(path))
    lines = logfiles.read_lines(spark, str(folder), split=True)
    assert lines.rdd.getNumPartitions() <= 20_000 * logfiles.OPEN_COST // logfiles.MOST_RANGE + 2 and not opened
    parts = logfiles.plan(spark, [str(folder)], None, True, False, None)
    assert sum(map(len, parts)) == 20_000 and not opened
    monkeypatch.undo()
    few = logfiles.read_lines(spark, [str(folder / f"0000{n}.log") for n in range(10)])
    assert few.where("line_no is not null").count() == 10


def test_many_long_files_are_looked_at_by_a_job(spark, folder, monkeypatch):
    for n in range(20):
        (folder / f"{n}.log").write_text(LINE.format(n=n) * 50)
    (folder / "z.log").write_bytes(gzip.compress(os.urandom(9_000)))
    opened = []
    monkeypatch.setattr(stores, "open_file", lambda path: opened.append(path))  # here, not in the job's workers
    parts = logfiles.plan(spark, [str(folder)], None, True, False, 1_000)
    monkeypatch.undo()
    assert not opened and sum(p.kind == "whole" for part in parts for p in part) == 1 and len(parts) > 60
    assert logfiles.read_lines(spark, str(folder / "1*.log"), split=True, splitBytes=1_000).where("line_no is not null").count() == 11 * 50


def test_packing_is_by_size_and_in_order():
    piece = lambda k, size: (splits.Piece(f"f{k}"), size)
    parts = logfiles.packed([piece(k, s) for k, s in enumerate([10, 20, 2_000_000, 5, 3_000_000, 1])], 1_000_000)
    assert [[p.path for p in part] for part in parts] == [["f0", "f1"], ["f2"], ["f3"], ["f4"], ["f5"]]
    assert logfiles.packed([], 1) == []


def test_queries_leave_nothing_cached(spark, sf_dir):
    from botledger.queries import QUERIES

    for name in ("report_summary", "report_json", "page_view", "read_report", "stream_report"):
        spark.catalog.clearCache()
        before = spark.sparkContext._jsc.getPersistentRDDs().size()
        QUERIES[name](spark, sf_dir).count()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before, name


def test_files_of_a_batch_are_dealt_over_tasks(tmp_path):
    """Small files share tasks, but not so that one task has all lines of packed ones."""
    from botledger.sources import logfiles

    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(100):
        (folder / f"{n}.log").write_text(LINE.format(n=n))
    stream = logfiles._Stream({"paths": str(folder), "ledger": str(tmp_path / "seen"), "tasks": "16"})
    parts = stream.partitions(stream.initialOffset(), stream.latestOffset())
    assert 14 <= len(parts) <= 17 and sum(len(p.pieces) for p in parts) == 100
