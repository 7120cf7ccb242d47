"""Sets of robots rules against paths: within a set through an index, and sets against tables of paths as an equi-join.

A rule matches paths that begin with its literal prefix (what stands before the first wildcard).
``RuleSet`` looks prefixes up by length, longest first, and verifies wildcard rules only where the
rarest stretch of their longest piece stands in the path, so a file's own rules are weighed against
each other in near-linear time. ``longest_matches`` joins rules and paths on (set, prefix length,
prefix hash): a path has one row for each prefix length that its set has, and only rules that share
the prefix are verified. No pair of a rule and a path is made otherwise.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a verdict names at most.
MAX_EVIDENCE = 10
#: A path below a rule's own that no Allow names.
PROBE = "~botledger-probe"
#: Signs of a wildcard rule's piece that it is looked up by.
STRETCH = 16


def probes(pattern: str) -> list[str]:
    """Paths that a pattern covers: itself without wildcards and, unless it is anchored, one below that."""
    anchored = pattern.endswith("$")
    path = pattern.replace("*", "")
    path = path.removesuffix("$")
    path = path if path.startswith("/") else "/" + path
    return [path] if anchored else [path, path + ("" if path.endswith("/") else "/") + PROBE]


class _Wild:
    """A rule with wildcards: each piece between them is taken at its leftmost place."""

    def __init__(self, pattern: str, key: tuple):
        self.key, self.anchored = key, pattern.endswith("$")
        self.first, *self.middle, self.last = pattern.removesuffix("$").split("*")
        self.longest = max((self.first, *self.middle, self.last), key=len)
        self.least = len(pattern.removesuffix("$").replace("*", ""))  # signs that a path must have at least

    def covers(self, path: str) -> bool:
        if not path.startswith(self.first):
            return False
        at = len(self.first)
        for piece in self.middle:
            at = path.find(piece, at)
            if at < 0:
                return False
            at += len(piece)
        if self.anchored:
            return len(path) - len(self.last) >= at and path.endswith(self.last)
        return path.find(self.last, at) >= 0


class RuleSet:
    """Rules by index: of a path the one with the longest pattern decides, Allow before Disallow, then the earlier."""

    def __init__(self, allows: list[bool], patterns: list[str]):
        best: dict[str, tuple] = {}  # of equal patterns the one that would win
        for i, (allow, p) in enumerate(zip(allows, patterns)):
            if p:
                key = (len(p), allow, -i)
                best[p] = max(best.get(p, key), key)
        self.prefixes: dict[str, tuple] = {}
        self.whole: dict[str, tuple] = {}
        wild = []
        for p, key in best.items():
            if "*" in p:
                wild.append(_Wild(p, key))
            elif p.endswith("$"):
                self.whole[p[:-1]] = key
            else:
                self.prefixes[p] = key
        self.lengths = sorted({len(p) for p in self.prefixes}, reverse=True)
        windows = lambda w: {w.longest[k : k + STRETCH] for k in range(max(1, len(w.longest) - STRETCH + 1))}
        often = collections.Counter(x for w in wild for x in windows(w))
        self.wild: dict[str, list[_Wild]] = collections.defaultdict(list)
        for w in sorted(wild, key=lambda w: w.key, reverse=True):
            self.wild[min(windows(w), key=lambda x: (often[x], x))].append(w)
        self.stretches = sorted({len(x) for x in self.wild})
        self._known: dict[str, tuple | None] = {}

    def decides(self, path: str) -> tuple | None:
        """(length, allow, -index) of the deciding rule, or null if none matches."""
        if path not in self._known:
            self._known[path] = self._find(path)
        return self._known[path]

    def _find(self, path: str) -> tuple | None:
        best = self.whole.get(path) or (0, False, 0)
        for n in self.lengths:
            if n < best[0]:
                break
            if n <= len(path) and (key := self.prefixes.get(path[:n])):
                best = max(best, key)
                break
        seen: set[str] = set()
        for n in self.stretches:
            for k in range(len(path) - n + 1 if n else 1):
                x = path[k : k + n]
                if x in self.wild and x not in seen:
                    seen.add(x)
                    for w in self.wild[x]:
                        if w.key < best:
                            break
                        if w.least <= len(path) and w.covers(path):
                            best = w.key
                            break
        return best if best[0] else None


def judge(allows: list[bool], patterns: list[str]) -> tuple[str, list[int]]:
    """A set's verdict on its site, and the rules behind it.

    Blocked if ``/`` is disallowed. Partial if some Disallow covers a path of its own on which the longest rule is a
    Disallow too; the first MAX_EVIDENCE of these are named. Else allowed, by the rule that decides on ``/``.
    """
    rules = RuleSet(allows, patterns)
    root = rules.decides("/")
    own = [] if root is None else [-root[2]]
    if root is not None and not root[1]:
        return "blocked", own
    still = []
    for i, (allow, p) in enumerate(zip(allows, patterns)):
        if not allow and p:
            alone = _Wild(p, ()) if "*" in p else None
            for path in probes(p):
                covered = alone.covers(path) if alone else path == p[:-1] if p.endswith("$") else path.startswith(p)
                if covered and (key := rules.decides(path)) is not None and not key[1]:
                    still.append(i)
                    break
            if len(still) == MAX_EVIDENCE:
                break
    return ("partial", still) if still else ("allowed", own)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [judge(a, p) for a, p in zip(b.column("allows").to_pylist(), b.column("patterns").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("mark"), pa.array([v for v, _ in out], pa.string()), pa.array([d for _, d in out], pa.list_(pa.int32()))], ["mark", "verdict", "at"])


def evaluate(rules: DataFrame) -> DataFrame:
    """verdict and deciding (the rules behind it) of each row of rules(..., rules array<struct<line, text, allow, pattern>>).

    Many sites have the same rules: each distinct list of (allow, pattern) is judged once, wherever it stands.
    """
    marked = rules.withColumns({"_allows": F.transform("rules", lambda r: r["allow"]), "_patterns": F.transform("rules", lambda r: r["pattern"])})
    marked = marked.withColumn("_mark", F.sha2(F.to_json(F.struct("_allows", "_patterns")), 256))
    once = marked.groupBy(F.col("_mark").alias("mark")).agg(F.any_value("_allows").alias("allows"), F.any_value("_patterns").alias("patterns"))
    judged = once.mapInArrow(_judged, "mark string, verdict string, at array<int>")
    out = marked.join(judged, F.col("_mark") == F.col("mark"))
    deciding = F.transform("at", lambda k: F.struct(F.get("rules", k)["line"].alias("line"), F.get("rules", k)["text"].alias("text")))
    return out.select(*rules.columns, "verdict", deciding.alias("deciding"))


def pattern_matches(pattern: Column, path: Column) -> Column:
    """Whether a rule's pattern covers a path, as a column. Each piece between wildcards is taken at its leftmost place, so the cost is linear."""
    anchored = F.endswith(pattern, F.lit("$"))
    pieces = F.split(F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern), "[*]", -1)
    last, n = F.element_at(pieces, -1), F.size(pieces)
    find = lambda p, at: F.call_function("locate", p, path, at + 1)
    at = F.aggregate(
        F.slice(pieces, 2, F.greatest(n - 2, F.lit(0))), F.length(pieces[0]),
        lambda a, p: F.when(a < 0, -1).when(p == "", a).when(find(p, a) == 0, -1).otherwise(find(p, a) - 1 + F.length(p)),
    )
    tail = F.when(anchored, (F.length(path) - F.length(last) >= at) & F.endswith(path, last)).otherwise((last == "") | (find(last, at) > 0))
    return (
        F.when(~F.startswith(path, pieces[0]), F.lit(False))
        .when(n == 1, ~anchored | (F.length(path) == F.length(pieces[0])))
        .otherwise((at >= 0) & tail)
    )


def longest_matches(rules: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, allowed, line): the say of the longest of the rules(keys, line, allow, pattern) that match each of the distinct paths(keys, path).

    On equal lengths Allow wins, then the earlier line; without a match a path is allowed (line null). Keys are compared as
    join keys are: rows with a null key have no rules.
    """
    bare = F.when(F.endswith("pattern", F.lit("$")), F.left("pattern", F.length("pattern") - 1)).otherwise(F.col("pattern"))
    stem = F.substring_index(bare, "*", 1)
    own = rules.where(F.coalesce(F.col("pattern") != "", F.lit(False))).select(*keys, "line", "allow", "pattern", F.length(stem).alias("_n"), F.xxhash64(stem).alias("_h"))
    lengths = own.groupBy(*keys).agg(F.collect_set("_n").alias("_lengths"))  # at most as many as a file has rules
    fitting = F.filter("_lengths", lambda n: n <= F.length("path"))
    spread = paths.join(lengths, keys, "left").select(*keys, "path", F.explode_outer(fitting).alias("_n")).withColumn("_h", F.xxhash64(F.left("path", F.col("_n"))))
    r = own.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_n").alias("_rn"), F.col("_h").alias("_rh"), "line", "allow", "pattern")
    same = (F.col("_n") == F.col("_rn")) & (F.col("_h") == F.col("_rh")) & pattern_matches(F.col("pattern"), F.col("path"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    hit = F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "allow", (-F.col("line")).alias("l")))
    best = spread.join(r, same, "left").groupBy(*keys, "path").agg(F.max(hit).alias("_b"))
    return best.select(*keys, "path", F.coalesce("_b.allow", F.lit(True)).alias("allowed"), (-F.col("_b.l")).alias("line"))
