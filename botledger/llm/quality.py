"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, all in built-in functions.

Edge cases: a null, empty or blank text has no words and fails the base rule; a null doc_id
cannot match a label but is judged like any other row; repeated rows get equal verdicts; with
no trusted label there is no model and the base rule alone decides; extra columns (even ones
named like an output) are replaced on the way out by this operator's own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.llm.common import words

#: Hash buckets of the two multinomials; fixed, so the model's size does not depend on the data.
BUCKETS = 1 << 14
#: Weights are stored as whole multiples of 1/STEP nat, so that sums do not depend on order.
STEP = 1024
#: Labelled documents (of each class) that set target multinomial and threshold, by least md5 of doc_id.
LABELLED_LIMIT = 20_000
#: Rejecting one trusted document costs as much as keeping this many bad ones.
TRUSTED_COST = 200
#: Added to the target's count of a bucket and to the count the raw corpus would lead one to expect.
PRIOR = 8.0
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_OWN = ("m", "_w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr_sum", "llr", "kept")


@dataclass(frozen=True)
class QualityModel:
    """weights: one integer per bucket, or empty; threshold: least length-normalised score that passes."""

    weights: tuple[int, ...]
    threshold: float


def _grams() -> str:
    """Array of hash buckets of a document's unigrams and bigrams (column w)."""
    return (
        f"concat(transform(w, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int)), "
        f"if(size(w) < 2, cast(array() as array<int>), transform(sequence(1, size(w) - 1), i -> cast(pmod(xxhash64(w[i - 1], w[i]), {BUCKETS}) as int))))"
    )


def _repeat_words() -> str:
    """Words of w covered by 8-word windows found twice or more: only texts with an equal pair of window hashes sort them."""
    windows = "if(size(w) < 8, cast(array() as array<bigint>), transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))))"
    cover = (
        "aggregate(array_sort(array_compact(transform(sequence(0, size(s) - 1), j -> "
        "if(get(s, j).h = get(s, j - 1).h or get(s, j).h = get(s, j + 1).h, get(s, j).i, null)))), "
        "named_struct('stop', 0, 'n', 0L), "
        "(acc, i) -> named_struct('stop', i + 8, 'n', acc.n + 8 - greatest(0, acc.stop - i)), acc -> acc.n)"
    )
    return (
        f"transform(array({windows}), win -> case when size(win) < 2 or size(array_distinct(win)) = size(win) then 0L "
        f"else transform(array(array_sort(transform(win, (h, i) -> named_struct('h', h, 'i', i)))), s -> {cover})[0] end)[0]"
    )


def measures(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs (without columns named like an output) plus a struct m of n_words, word_chars, n_repeat_words and llr.

    The words are bound by a lambda, so that a filter pushed down through the struct splits a text once,
    not once for each mention of its words.
    """
    if model.weights:
        table = ",".join(map(str, model.weights))
        weight = f"cast(split('{table}', ',') as array<int>)"
        total = f"aggregate({_grams()}, 0L, (acc, g) -> acc + get({weight}, g))"
        llr = f"if(size(w) = 0, null, {total} / (2 * size(w) - 1) / {float(STEP)})"
    else:
        llr = "cast(null as double)"
    fields = (
        "'n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint), "
        f"'n_repeat_words', {_repeat_words()}, 'llr', {llr}"
    )
    split = words(F.col("text").cast("string"))
    return docs.drop(*_OWN).withColumn("_w", F.array(split)).withColumn("m", F.expr(f"transform(_w, w -> named_struct({fields}))[0]")).drop("_w")


BASE_FAILED = f"(m.n_words < {MIN_WORDS} or 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words)"


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Multinomials over all documents (raw) and the trusted ones (target), then a threshold from labelled scores."""
    spark = docs.sparkSession
    labelled = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("good"))
        .withColumn("_o", F.md5(F.col("doc_id").cast("string")))
    )
    # counts by hash bucket say which buckets hold the first of each class, so only these are ordered, however many labels there are
    labelled = labelled.withColumn("_b", F.substring("_o", 1, 3))
    counts = labelled.groupBy("good", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("good").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where(F.col("before") < LABELLED_LIMIT).groupBy("good").agg(F.max("_b").alias("_last"))
    near = labelled.join(F.broadcast(last), "good").where("_b <= _last")  # one row for each class
    parts = [near.where(F.col("good") == g).orderBy("_o", "doc_id").limit(LABELLED_LIMIT).select("doc_id", "good", "_o") for g in (0, 1)]
    # three quarters of the trusted documents make the target; the rest, never seen by it, and the bad ones set the threshold
    chosen = [(r["doc_id"], r["good"], int(r["good"] == 1 and int(r["_o"][-1], 16) % 4 != 3)) for p in parts for r in p.collect()]
    if not any(t for _, _, t in chosen):
        return QualityModel((), 0.0)
    known = F.broadcast(spark.createDataFrame(chosen, "doc_id long, good int, in_target int"))
    toks = docs.select("doc_id", words(F.col("text").cast("string")).alias("w"))
    grams = toks.join(known, "doc_id", "left").select(F.coalesce(F.col("in_target"), F.lit(0)).alias("t"), F.explode(F.expr(_grams())).alias("g"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in grams.groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect():
        raw[r["g"]], target[r["g"]] = r["raw"], r["target"]
    share = sum(target) / max(1, sum(raw))
    weights = tuple(round(STEP * math.log((t + PRIOR) / (r * share + PRIOR))) for r, t in zip(raw, target))
    cells = (
        measures(docs.select("doc_id", "text").join(known.where("in_target = 0"), "doc_id"), QualityModel(weights, 0.0))
        .select("good", F.expr(f"if({BASE_FAILED}, null, floor(m.llr * 500))").alias("cell"))
        .groupBy("cell").agg(F.count_if(F.col("good") == 0).alias("bad"), F.count_if(F.col("good") == 1).alias("good")).collect()
    )
    return QualityModel(weights, _threshold({r["cell"]: (r["bad"], r["good"]) for r in cells if r["cell"] is not None}))


def _threshold(cells: dict[int, tuple[int, int]]) -> float:
    """The cut (in steps of 1/500 nat) with the most bad rejected less TRUSTED_COST times the trusted; half way across the empty cells below it."""
    best, cut, gain = 0, None, 0
    order = sorted(cells)
    for at, c in enumerate(order):
        gain += cells[c][0] - TRUSTED_COST * cells[c][1]
        if gain > best:
            best, cut = gain, (c + 1, order[at + 1] if at + 1 < len(order) else c + 1)
    if cut is None:
        return -1e9 if not order else (order[0] - 1) / 500
    return (cut[0] + cut[1]) / 2 / 500


def _kept(model: QualityModel) -> str:
    return f"not {BASE_FAILED} and coalesce(m.llr >= {model.threshold!r}D, true)" if model.weights else f"not {BASE_FAILED}"


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Every row of docs with its counts, llr (mean n-gram weight in nats; null without words or model) and kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        measures(docs, model)
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0].cast("long"))
        .withColumns({c: F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_repeat_words", "llr")})
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", F.expr(_kept(model)))
        .drop("m")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns they had."""
    model = fit(docs, labels)
    cols = docs.columns
    return measures(docs.withColumns({f"_in{i}": F.col(f"`{c}`") for i, c in enumerate(cols)}), model).where(_kept(model)).select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(cols)]
    )


def apply_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
