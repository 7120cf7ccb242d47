"""Large catalogues as joins, equal to the chain of tests, and catalogues that change while a stream runs."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from botledger.operators import classify, signals
from botledger.queries import _AGENTS, _REFERRERS
from botledger.sources import catalogue


def requests(spark, agents, referrers):
    rows = [(i, a, referrers[i % len(referrers)]) for i, a in enumerate(agents)]
    return spark.createDataFrame(rows, "i long, ua string, referrer string")


def plan_size(df):
    return len(df._jdf.queryExecution().analyzed().toString())


def test_joins_equal_the_chain(spark):
    agents = [a for a, _ in _AGENTS] * 2 + [None, "", "gptbotclaudebot", "GPTBOT", "İGPTBot"]
    referrers = [r for r, _ in _REFERRERS] + [None, "https://www.claude.ai:8/", "https://a.b.c.d.e.claude.ai/"]
    req = requests(spark, agents, referrers)
    rows = lambda df: sorted((r["i"], r["crawler_id"], r["referral_id"]) for r in df.collect())
    for own in (None, "www.Claude.ai"):
        got = signals.classify_by(req, signals.token_frame(spark), signals.host_frame(spark), own)
        assert rows(got) == rows(classify.classify(req, own)) and got.columns[:3] == req.columns


def test_five_thousand_tokens(spark):
    rng = random.Random(4)
    tokens = [("".join(rng.choices("abcdxyz", k=rng.randrange(1, 12))) + ("-bot" if k % 2 else "")) for k in range(5_000)]
    catalog = spark.createDataFrame([(f"id{k}", x.upper() if k % 3 else x, k) for k, x in enumerate(tokens)], "id string, token string, ord long")
    agents = ["Mozilla/5.0 (" + "".join(rng.choices("abcdxyz-", k=rng.randrange(0, 25))) + rng.choice(["", "-bot", "-BOT/1"]) + ")" for _ in range(400)]
    got = {r["ua"]: r["crawler_id"] for r in signals.crawlers_of(requests(spark, agents, [None]).select("ua").distinct(), catalog).collect()}
    order = sorted(range(5_000), key=lambda k: (-len(tokens[k]), k))
    want = {a: next((f"id{k}" for k in order if tokens[k].lower() in a.lower()), None) for a in agents}
    assert {a: got.get(a) for a in agents} == want
    req = requests(spark, agents, [None])
    small, large = (signals.classify_by(req, catalog.limit(n), signals.host_frame(spark)) for n in (30, 5_000))
    assert plan_size(large) < 1.1 * plan_size(small)  # a stretch size more or less
    assert "NestedLoop" not in large._jdf.queryExecution().executedPlan().toString()


def test_no_tokens_and_no_hosts(spark):
    req = requests(spark, ["GPTBot", None], ["https://claude.ai/"])
    out = signals.classify_by(req, signals.token_frame(spark, []), signals.host_frame(spark, []))
    assert {(r["crawler_id"], r["referral_id"]) for r in out.collect()} == {(None, None)}


def test_a_stream_picks_up_a_changed_catalogue(spark, tmp_path):
    path, folder, seen = tmp_path / "signals.json", tmp_path / "in", {}
    data = catalogue.dump()
    folder.mkdir()

    def write(crawlers, version=data["schema_version"]):
        (tmp_path / "new").write_text(json.dumps(data | {"schema_version": version, "crawlers": crawlers}))
        os.replace(tmp_path / "new", path)

    def come(n):
        req = requests(spark, ["GPTBot", "an ownbot/1"], ["https://claude.ai/"])
        req.coalesce(1).write.mode("append").json(str(folder))
        q.processAllAvailable()
        return seen[n]

    write(data["crawlers"])
    stream = spark.readStream.schema("i long, ua string, referrer string").json(str(folder))
    q = signals.tag_batches(stream, str(path), lambda df, n: seen.__setitem__(n, {r["ua"]: (r["crawler_id"], r["referral_id"]) for r in df.collect()}), str(tmp_path / "cp"))
    try:
        assert come(0) == {"GPTBot": ("openai-gptbot", None), "an ownbot/1": (None, "claude")}
        write([data["crawlers"][0] | {"id": "x-own", "token": "OwnBot"}])
        assert come(1) == {"GPTBot": (None, "claude"), "an ownbot/1": ("x-own", None)}
        write([], version=99)  # a file that can't be used changes nothing
        assert come(2) == seen[1]
    finally:
        q.stop()
    with pytest.raises(ValueError, match="schema version"):
        signals.Versions(str(path)).rows()
    assert catalogue.CRAWLERS[0][1] != "x-own"  # nothing of the process has changed
