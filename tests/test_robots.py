"""robots.txt verdicts against a plain reading of the rules, hostile files, and rules by pages as a join."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from botledger.operators import robots, rulesets
from botledger.plans.engine import Engine

FILES = {
    "empty": "",
    "absent": None,
    "star_block": "User-agent: *\nDisallow: /",
    "star_open": "# hi\r\nUser-agent: *\r\nDisallow:\r\n",
    "home_only": "User-agent: *\nDisallow: /\nAllow: /$",
    "named": "User-agent: GPTBot\nUser-agent: CCBot/2.0\nDisallow: /\n\nUser-agent: *\nDisallow: /private/ # secret\nAllow: /private/open\nSitemap: https://x/s.xml\n",
    "two_groups": "Disallow: /lost\nuser-agent: claudebot\nDisallow: /a\nUser-agent: bingbot\nAllow: /\nUSER-AGENT: ClaudeBot\nDisallow: /b*\nAllow: /b\n",
    "wild": "User-agent: *\nDisallow: /*.pdf$\nDisallow: /x*y\nAllow: /x*yes\nDisallow: *\nAllow: /",
    "rescued": "User-agent: *\nDisallow: /docs\nAllow: /docs\nDisallow: /tmp$\nAllow: /tmp$\n",
    "crowded": "".join(f"User-agent: GPTBot\nDisallow: /part{i}\n\n" for i in range(14)) + "User-agent: *\nDisallow: /one\n",
}


def covers(pattern, path):
    if not pattern:
        return False
    end = r"\Z" if pattern.endswith("$") else ""
    return re.match(".*".join(map(re.escape, pattern.removesuffix("$").split("*"))) + end, path, re.S) is not None


def decided(rules, path):
    """(allowed, line) by trying every rule."""
    hits = [(len(p), allow, -i) for i, (allow, p) in enumerate(rules) if covers(p, path)]
    return (True, None) if not hits else (max(hits)[1], -max(hits)[2])


def judged(rules):
    """A Disallow still holds on a path of its own unless an Allow as long covers it that no longer Disallow takes back."""
    allowed, own = decided(rules, "/")
    if not allowed:
        return "blocked", [own]
    still = []
    for i, (allow, p) in enumerate(rules):
        if allow or not p:
            continue
        for path in rulesets.probes(p):
            rescue = max((len(q) for a, q in rules if a and len(q) >= len(p) and covers(q, path)), default=-1)
            if covers(p, path) and (rescue < 0 or any(not a and len(q) > rescue and covers(q, path) for a, q in rules)):
                still.append(i)
                break
    return ("partial", still[: rulesets.MAX_EVIDENCE]) if still else ("allowed", [] if own is None else [own])


def some_rules(rng, n, letters="ab/*$"):
    return [(rng.random() < 0.5, "/" * (rng.random() < 0.8) + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 7))) + "$" * (rng.random() < 0.2)) for _ in range(n)]


def test_sets_of_random_rules_are_judged_as_by_trying_all():
    rng = random.Random(5)
    kinds = set()
    for k in range(3_000):
        rules = some_rules(rng, rng.randrange(0, 9), "ab/*$" if k % 2 else "ab*")
        got = rulesets.judge([a for a, _ in rules], [p for _, p in rules])
        assert got == judged(rules), rules
        kinds.add(got[0])
        index = rulesets.RuleSet([a for a, _ in rules], [p for _, p in rules])
        for path in ["/", "/a", "/ab/ba", "", "/" + "ab" * 6, "b$a"]:
            key = index.decides(path)
            assert ((True, None) if key is None else (key[1], -key[2])) == decided(rules, path), (rules, path)
    assert kinds == {"allowed", "blocked", "partial"}


def test_verdicts_of_files_made_by_hand(spark):
    docs = spark.createDataFrame(list(FILES.items()), "doc string, text string")
    v = robots.verdicts(docs).where("token in ('GPTBot', 'ClaudeBot', 'CCBot', 'bingbot')")
    got = {(r["doc"], r["token"]): (r["verdict"], r["source"], [x["line"] for x in r["lines"]]) for r in v.collect()}
    assert got["absent", "GPTBot"] == ("allowed", "none", []) and got["empty", "CCBot"] == ("allowed", "none", [])
    assert got["star_block", "GPTBot"] == ("blocked", "star", [1, 2]) and got["star_open", "GPTBot"] == ("allowed", "star", [2])
    assert got["home_only", "CCBot"] == ("partial", "star", [1, 2])
    assert got["named", "CCBot"] == ("blocked", "token", [2, 3]) and got["named", "ClaudeBot"] == ("partial", "star", [5, 6])
    assert got["two_groups", "ClaudeBot"] == ("partial", "token", [2, 3, 6, 7]) and got["two_groups", "bingbot"] == ("allowed", "token", [4, 5])
    assert got["rescued", "GPTBot"][0] == "allowed" and got["crowded", "GPTBot"][1] == "token"
    lines = got["crowded", "GPTBot"][2]
    assert len(lines) == 20 and lines == sorted(lines)  # ten agent lines and ten rules
    outlook = {r["doc"]: r["outlook"] for r in robots.next_crawler(docs, robots.verdicts(docs)).collect()}
    assert outlook["absent"] == "none" and outlook["empty"] == "open" and outlook["star_block"] == "closed" and outlook["two_groups"] == "open"


PATTERNS = ["/", "/fish", "/fish*", "/fish/", "/*.php", "/*.php$", "/fish*.php", "*", "$", "/$", "/a*b*c$", "/a%b_c", "*x", "/**y", ""]
PATHS = ["/", "/fish", "/fish.html", "/fish/salmon.html", "/Fish", "/index.php", "/folder/x.php?a", "/fishheads/c.php", "/abc", "/aXbYc", "/aXbYcZ", "/a%b_c", "/zzx", "/y", "", "fish"]


def test_patterns_on_paths(spark):
    pairs = spark.createDataFrame([(p, s) for p in PATTERNS for s in PATHS], "pattern string, path string")
    for r in pairs.withColumn("hit", rulesets.pattern_matches(F.col("pattern"), F.col("path"))).collect():
        assert r["hit"] == (covers(r["pattern"], r["path"]) if r["pattern"] else True), r
        if "*" in r["pattern"]:
            assert rulesets._Wild(r["pattern"], ()).covers(r["path"]) == r["hit"]


def test_rules_by_pages(spark):
    rng = random.Random(9)
    sets = {f"s{k}": some_rules(rng, 12) for k in range(40)} | {"none": []}
    paths = sorted({"/" + "".join(rng.choice("ab/$") for _ in range(rng.randrange(0, 8))) for _ in range(60)}) + [""]
    rules = spark.createDataFrame([(c, i, a, p) for c, rs in sets.items() for i, (a, p) in enumerate(rs)], "case string, line int, allow boolean, pattern string")
    asked = spark.createDataFrame([(c, p) for c in sets for p in paths] * 2, "case string, path string")
    out = robots.decide(rules, asked)
    got = {(r["case"], r["path"]): (r["allowed"], r["line"]) for r in out.collect()}
    assert got == {(c, p): decided(rs, p) for c, rs in sets.items() for p in paths}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_access_of_crawlers_to_pages(spark):
    docs = spark.createDataFrame(list(FILES.items()), "doc string, text string")
    pages = spark.createDataFrame([(d, p) for d in [*FILES, "unknown", None] for p in ("/", "/private/open/x", "/a", "/b", None)], "doc string, path string")
    rows = robots.page_access(docs, pages).collect()
    assert len(rows) == 11 * 4 * 28
    got = {(r["doc"], r["path"], r["id"]): (r["source"], r["allowed"], r["line"]) for r in rows}
    assert got["named", "/private/open/x", "anthropic-claudebot"] == ("star", True, 7) and got["named", "/a", "openai-gptbot"] == ("token", False, 3)
    assert got["unknown", "/", "openai-gptbot"] == ("none", True, None) == got["absent", "/a", "openai-gptbot"]
    assert got["two_groups", "/b", "anthropic-claudebot"][1:] == (False, 7) and got["two_groups", "/a", "anthropic-claudebot"][1:] == (False, 3)


@pytest.mark.parametrize(
    "rules",
    [
        [(True, f"/a{i:05d}") for i in range(1_500)] + [(False, f"/d{i:05d}") for i in range(1_500)],
        [(True, f"/p{i:05d}") for i in range(1_500)] + [(False, f"/p{i:05d}") for i in range(1_500)],
        [(i % 2 == 0, f"/q{i // 2:05x}") for i in range(45_000)],
        [(i % 2 == 0, f"/*{i // 2:05x}*") for i in range(45_000)],
        [(i % 2 == 0, "/*" + "a" * (i // 2)) for i in range(1_400)],
        [(i % 2 == 0, "/" + "a" * (i // 2)) for i in range(1_400)],
        [(False, "*a" * 5_000 + "$"), (True, "/" + "a" * 5_000)],
        [(i % 2 == 0, "/*" + "".join("ab"[i >> 1 >> b & 1] for b in range(14))) for i in range(20_000)],
    ],
)
def test_hostile_sets_cost_little(rules):
    began = time.process_time()
    rulesets.judge([a for a, _ in rules], [p for _, p in rules])
    assert time.process_time() - began < (0.5 if len(rules) == 3_000 else 5)


def test_a_hostile_file_costs_little_beyond_the_start(spark):
    engine = Engine(spark)
    file = lambda n: "User-agent: *\n" + "".join(f"Allow: /x{i:05d}/\nDisallow: /x{i:05d}/\n" for i in range(n))
    took = []
    for text in (file(1), file(1), file(1_500)):
        began = time.time()
        assert {r["verdict"] for r in engine.robots(text).collect()} == {"allowed"}
        took.append(time.time() - began)
    assert took[2] < took[1] + 1.5


def test_equal_sets_are_judged_once(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"# site {i}\nUser-agent: *\nDisallow: /x{i % 2}\n") for i in range(200)], "doc string, text string")
    v = robots.verdicts(docs).where("token = 'CCBot'").collect()
    assert {(r["verdict"], r["lines"][1]["text"]) for r in v} == {("partial", "Disallow: /x0"), ("partial", "Disallow: /x1")}
    rules = docs.select("doc", F.array(F.struct(F.lit(3).alias("line"), F.col("doc").alias("text"), F.lit(False).alias("allow"), F.concat(F.lit("/x"), (F.substring("doc", 2, 9).cast("int") % 2).cast("string")).alias("pattern"))).alias("rules"))
    seen = rulesets.evaluate(rules)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Aggregate") > 0 and "MapInArrow" in plan
    assert {(r["verdict"], r["deciding"][0]["text"] == r["doc"]) for r in seen.collect()} == {("partial", True)}
