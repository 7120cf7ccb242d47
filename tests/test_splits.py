"""Long files in parts: CloudFront's with headers that change, gzip by members, whatever their cuts, padding and damage."""

import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from botledger.plans.engine import Engine
from botledger.sources import logfiles, splits

LINE = '198.51.100.{n} - - [03/Mar/2026:10:00:00 +0000] "GET /p{n} HTTP/1.1" 200 5 "-" "GPTBot {pad}"\n'


@pytest.fixture()
def engine(spark):
    return Engine(spark)


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data)
    return str(path)


def text(n, seed=0):
    rng = random.Random(seed)
    return "".join(LINE.format(n=i, pad="".join(rng.choices("abcdefgh", k=40))) for i in range(n)).encode()


def same_rows(engine, path, most, parts):
    """A file in parts has the rows, in order, and the status of the file read whole; returns its truncated mark."""
    split = engine.lines(path, split=True, splitBytes=most)
    kinds = [p for part in logfiles.plan(engine.spark, [path], None, True, False, most) for p in part]
    assert len(kinds) >= parts and split.rdd.getNumPartitions() >= parts, kinds
    cols = ["line", "fmt", "spots"]
    got = split.where("line_no is not null").orderBy("line_no").select(*cols).collect()
    want = engine.lines(path).where("line_no is not null").orderBy("line_no").select(*cols).collect()
    assert got == want
    ends = [[tuple(r) for r in df.where("line_no is null").select("truncated", "fmt", "line").collect()] for df in (split, engine.lines(path))]
    assert ends[0] == ends[1] and len(ends[0]) == 1
    return ends[0][0][0]


FIELDS = ["date time cs-uri-stem sc-status cs(Referer) cs(User-Agent)", "sc-status date time cs-uri-stem cs(User-Agent) cs(Referer)", "date time", "x date x time x cs-uri-stem sc-status cs(Referer) cs(User-Agent)"]


def cloudfront(n, change, head=True):
    values = {"date": "2026-03-03", "time": "09:00:00", "sc-status": "200", "cs(Referer)": "-", "cs(User-Agent)": "GPTBot", "x": "-"}
    out, fields = ["#Version: 1.0", "#Fields: " + FIELDS[0]] if head else [], FIELDS[0]
    for i in range(n):
        if i % change == change - 1:
            new = FIELDS[i // change % 4]
            out.append("#Fields: " + new)
            fields = new if new != "date time" else fields  # a useless header changes nothing
        out.append("\t".join(values.get(c) or f"/p{i}" for c in fields.split()))
    return ("\n".join(out) + "\n").encode()


@pytest.mark.parametrize("change", [7, 90, 100_000])
@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
def test_cloudfront_ranges_start_with_the_header_that_holds(engine, tmp_path, change, end):
    data = cloudfront(600, change).replace(b"\n", end)
    path = put(tmp_path, "c.log", data)
    same_rows(engine, path, len(data) // 10, 10)
    whole, parts = (engine.report(path, split=s, splitBytes=len(data) // 10).to_dict() for s in (False, True))
    assert whole == parts and whole["summary"]["records"] == 600


def test_cloudfront_without_a_header_has_the_standard_columns(engine, tmp_path):
    values = {"date": "2026-03-03", "time": "09:00:00", "sc-status": "200", "cs(Referer)": "-", "cs(User-Agent)": "GPTBot"}
    from botledger.operators.lines import CLOUDFRONT_FIELDS

    data = "".join("\t".join(values.get(c) or f"/p{i}" for c in CLOUDFRONT_FIELDS) + "\n" for i in range(300)).encode() + cloudfront(50, 20)
    path = put(tmp_path, "s.log", data)
    same_rows(engine, path, len(data) // 7, 7)
    assert engine.report(path, splitBytes=len(data) // 7).to_dict()["summary"]["records"] == 350


def members(plain, n, whole_lines=True):
    cuts = [len(plain) * k // n for k in range(n + 1)]
    if whole_lines:
        cuts = [0] + [plain.rindex(b"\n", 0, c) + 1 for c in cuts[1:-1]] + [len(plain)]
    return [gzip.compress(plain[a:z]) for a, z in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("whole_lines", [True, False])
def test_gzip_of_fifty_members_reads_in_many_tasks(engine, tmp_path, whole_lines):
    parts = members(text(3_000), 50, whole_lines)
    data = b"".join(parts)
    for name, more, damaged in (("plain", b"", False), ("padded", bytes(3_000), False), ("garbage", b"no gzip", True), ("padded garbage", bytes(9) + b"x", True)):
        assert same_rows(engine, put(tmp_path, name.replace(" ", ""), data + more), len(data) // 9, 8) is damaged
    assert same_rows(engine, put(tmp_path, "cut", data[: -len(parts[-1]) // 2]), len(data) // 9, 8) is True
    broken = bytearray(data)
    at = sum(map(len, parts[:25])) + len(parts[25]) - 5  # a check sum in the middle: what follows is read in order up to there
    broken[at] ^= 1
    assert same_rows(engine, put(tmp_path, "sum", bytes(broken)), len(data) // 9, 4) is True


def test_gzip_members_within_members_and_odd_ones(engine, tmp_path):
    plain = text(400)
    inner = gzip.compress(b"198.51.100.1 - - [x] \"a\" - 0 \"b\" \"c\"\n" * 3)
    press = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the inner file stands in it as it is
    stored = press.compress(plain + inner + b"\n" + plain) + press.flush()
    empty, named = gzip.compress(b""), b"\x1f\x8b\x08\x08\0\0\0\0\0\xffname\0" + gzip.compress(plain)[10:]
    data = b"".join([gzip.compress(plain[:-5]), empty, gzip.compress(plain[-5:]), stored, named, empty, gzip.compress(b"no end")])
    assert same_rows(engine, put(tmp_path, "odd", data), 5_000, 4) is False
    for k in (3_000, 777):
        assert same_rows(engine, put(tmp_path, f"odd{k}", data), k, 4) is False


def test_gzip_of_one_member_or_of_cr_lines_stays_whole(spark, engine, tmp_path):
    for name, data in (("one", gzip.compress(text(500))), ("cr", b"".join(members(text(500), 5)).replace(b"", b"") and b"".join(gzip.compress(text(100, k).replace(b"\n", b"\r")) for k in range(5)))):
        path = put(tmp_path, name, data)
        assert [p.kind for part in logfiles.plan(spark, [path], None, True, False, 1_000) for p in part] == ["whole"]
        assert engine.lines(path, split=True, splitBytes=1_000).where("line_no is not null").count() == 500


def test_short_ranges_share_tasks(spark, engine, tmp_path):
    """Tasks and what each is sent don't grow with the number of ranges; each line is read once."""
    plain, packed = text(6_000), b"".join(members(text(6_000, 1), 60))
    paths = [put(tmp_path, "plain", plain), put(tmp_path, "packed", packed)]
    plans = [logfiles.plan(spark, paths, None, True, False, most) for most in (500, 2_000)]
    assert all(len(p) < 6 * spark.sparkContext.defaultParallelism for p in plans) and sum(map(len, plans[0])) < 2 * len(plans[0])
    rows = engine.lines(paths, split=True, splitBytes=500).where("line_no is not null")
    assert rows.count() == 12_000 == rows.select("line").distinct().count()


def test_tasks_are_not_sent_the_plan():
    import pickle

    options = {"plan": logfiles.json.dumps([[splits.Piece(f"f{k}")] for k in range(5_000)])}
    reader = logfiles._Reader(options)
    assert len(pickle.dumps(reader)) < 1_000 and len(reader.partitions()) == 5_000


def test_numbers_of_lines_rise_over_parts(engine, tmp_path):
    path = put(tmp_path, "n", b"".join(members(text(2_000), 20)))
    rows = engine.lines(path, split=True, splitBytes=4_000).where("line_no is not null")
    assert rows.select("line_no").distinct().count() == 2_000
    assert rows.select(F.max("line_no")).first()[0] <= len(text(2_000))


def test_a_member_is_known_by_its_trailer(tmp_path):
    data = gzip.compress(b"abc\n")
    path = put(tmp_path, "m", b"junk" + data + data[:-1])
    with open(path, "rb") as f:
        assert splits._member(f, 4) == {"start": 4, "stop": 4 + len(data), "size": 4, "ends": True}
        assert splits._member(f, 4 + len(data)) is None and splits._member(f, 0) is None
