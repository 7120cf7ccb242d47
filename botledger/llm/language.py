"""Language ID: a linear-chain conditional random field labels each word, so switches inside a text are seen.

A word's potentials come from hashed affixes, character n-grams and the word itself, and from
the lexicon of each language's commonest words; transitions are learned with them. Marginals
come from forward-backward over a text's whole word sequence; the text's language is the one
with the largest mean marginal, its score that mean.

Training reads whole texts of at most SAMPLE_PER_LANG documents of each language (least md5 of
doc_id), on the driver, with fixed seeds. lang, source and doc_id are never features.

Edge cases: null texts and texts without a letter are ``und`` with score 0; long texts are
read whole; rows that repeat get equal answers; a null doc_id counts as not held out and is
never sampled; without any labelled text everything is ``und``; clashing columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.llm.common import lean

SAMPLE_PER_LANG = 120
#: Digits of a document's md5 that name its bucket when the sample is drawn.
BUCKET_DIGITS = 3
#: Hashed feature rows, and the commonest words of a language that make its lexicon.
FEATURES = 1 << 15
LEXICON = 200
#: Words of a training sequence; a part of them is put together from two languages.
SEQUENCE = 40
SWITCHED = 0.3
EPOCHS, BATCHES, RATE, DECAY = 6, 6, 0.4, 1e-5
#: Words kept with their potentials in a worker, and words of a batch labelled together.
CACHE_WORDS = 400_000
BATCH_WORDS = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile("[A-Za-z\u00c0-\u024f]")


def split_words(text: str | None) -> list[str]:
    """Runs of letters, lower case; none in a text without a letter (superscripts and fractions alone are not)."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    if words and not _LETTER.search(low) and not any(c.isalpha() for c in low):
        return []
    return words


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return (h % np.uint64(FEATURES)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words in a row, sorted by word, and where each word's begin."""
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n) + 2
    text = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(n), lens)
    starts = np.cumsum(lens) - lens
    found, owner = [], []
    for size in (2, 3, 4):
        if len(code) < size:
            continue
        at = np.arange(len(code) - size + 1)
        at = at[word[at] == word[at + size - 1]]
        found.append(_hash(size, *(code[at + i] for i in range(size))))
        owner.append(word[at])
    for size in (1, 2, 3):
        at = np.flatnonzero(lens - 2 >= size)
        found.append(_hash(10 + size, *(code[starts[at] + 1 + i] for i in range(size))))
        found.append(_hash(20 + size, *(code[starts[at] + lens[at] - 2 - i] for i in range(size))))
        owner += [at, at]
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, word, code * (np.arange(len(code), dtype=np.uint64) - np.repeat(starts, lens).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    found.append(_hash(30, whole))
    owner.append(np.arange(n))
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(n))


class Crf:
    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((FEATURES, k))
        self.lexicon: dict[str, np.ndarray] = {}
        self.lexicon_weight = np.zeros(k)
        self.transitions = np.zeros((k, k))

    def potentials(self, words: list[str]) -> np.ndarray:
        rows, starts = features(words)
        size = np.diff(np.append(starts, len(rows)))[:, None]
        out = np.add.reduceat(self.weights[rows], starts, axis=0) / np.sqrt(size)
        return out + self._lexicon(words) * self.lexicon_weight

    def _lexicon(self, words: list[str]) -> np.ndarray:
        none = np.zeros(len(self.labels))
        return np.array([self.lexicon.get(w, none) for w in words]).reshape(len(words), len(self.labels))

    def marginals(self, potentials: np.ndarray, lens: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Label marginals of each word of sequences that lie one after another; adds pair marginals to ``pairs``."""
        k = potentials.shape[1]
        order = np.argsort(-lens, kind="stable")
        n = lens[order]
        first = (np.cumsum(lens) - lens)[order]
        lift = np.exp(potentials - potentials.max(axis=1, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max())
        alpha = np.empty_like(lift)
        live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")  # sequences longer than t
        cur = np.zeros((0, k))
        for t, m in enumerate(live.tolist()):
            at = first[:m] + t
            cur = lift[at] if t == 0 else (cur[:m] @ step) * lift[at]
            cur /= cur.sum(axis=1, keepdims=True)
            alpha[at] = cur
        beta = np.ones((len(n), k))
        for t in range(len(live) - 1, -1, -1):
            m = int(live[t])
            at = first[:m] + t
            ahead = alpha[at] * beta[:m]
            alpha[at] = ahead / ahead.sum(axis=1, keepdims=True)
            if t:
                back = lift[at] * beta[:m]
                if pairs is not None:
                    forward = alpha[first[:m] + t - 1]  # not yet replaced by marginals
                    joint = forward[:, :, None] * step[None] * back[:, None, :]
                    pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                nxt = back @ step.T
                beta[:m] = nxt / nxt.sum(axis=1, keepdims=True)
        return alpha


def train(samples: list[tuple[str, str]]) -> Crf:
    """A field fitted to (language, text) pairs by adaptive gradient steps on the conditional likelihood."""
    model = Crf(sorted({lang for lang, _ in samples}))
    k, rng = len(model.labels), np.random.default_rng(7)
    number = {x: i for i, x in enumerate(model.labels)}
    pieces: list[list[list[str]]] = [[] for _ in range(k)]
    counts = [Counter() for _ in range(k)]
    for lang, text in samples:
        ws = split_words(text)
        counts[number[lang]].update(ws)
        pieces[number[lang]] += [ws[i : i + SEQUENCE] for i in range(0, len(ws), SEQUENCE)]
    for i, c in enumerate(counts):
        for w, _ in c.most_common(LEXICON):
            model.lexicon.setdefault(w, np.zeros(k))[i] = 1.0
    runs = [[(i, p)] for i in range(k) for p in pieces[i]]
    if k > 1:
        for _ in range(int(SWITCHED * len(runs))):
            a, b = rng.choice(k, 2, replace=False).tolist()
            if pieces[a] and pieces[b]:
                pick = [(x, pieces[x][rng.integers(len(pieces[x]))]) for x in (a, b)]
                runs.append([(x, p[: SEQUENCE // 2]) for x, p in pick])
    vocabulary = sorted({w for r in runs for _, p in r for w in p})
    place = {w: i for i, w in enumerate(vocabulary)}
    rows, starts = features(vocabulary) if vocabulary else (np.empty(0, np.int64), np.empty(0, np.int64))
    size = np.diff(np.append(starts, len(rows)))
    share, lexicon = np.repeat(1 / np.sqrt(size), size), model._lexicon(vocabulary)
    squares = [np.full_like(x, 1e-6) for x in (model.weights, model.transitions, model.lexicon_weight)]
    order = rng.permutation(len(runs))
    for epoch in range(EPOCHS):
        for part in np.array_split(order, BATCHES):
            if not len(part):
                continue
            seqs = [runs[i] for i in part.tolist()]
            word = np.array([place[w] for r in seqs for _, p in r for w in p])
            gold = np.array([x for r in seqs for x, p in r for _ in p])
            lens = np.array([sum(len(p) for _, p in r) for r in seqs])
            by_word = np.add.reduceat(model.weights[rows] * share[:, None], starts, axis=0) + lexicon * model.lexicon_weight
            pairs = np.zeros((k, k))
            post = model.marginals(by_word[word], lens, pairs)
            post[np.arange(len(gold)), gold] -= 1
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lens) - lens] = False
            at = np.flatnonzero(inner)
            np.add.at(pairs, (gold[at - 1], gold[at]), -1)
            slope = np.stack([np.bincount(word, post[:, i], len(vocabulary)) for i in range(k)], axis=1)
            spread = np.repeat(slope, size, axis=0) * share[:, None]
            grads = [
                np.stack([np.bincount(rows, spread[:, i], FEATURES) for i in range(k)], axis=1) / len(gold) + DECAY * model.weights,
                pairs / len(gold),
                (slope * lexicon).sum(axis=0) / len(gold),
            ]
            for x, g, s in zip((model.weights, model.transitions, model.lexicon_weight), grads, squares):
                s += g * g
                x -= RATE * g / np.sqrt(s)
    return model


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) of the SAMPLE_PER_LANG first labelled documents of each language in md5 order of doc_id whose crc32(doc_id) is not 2 modulo 4 (repeated rows among them come once).

    Counts by language and hash bucket, combined before they move, say which buckets hold them; only
    the keys in these are ranked, however many documents a language has, and the texts of those
    chosen (no more than are collected to train on) are read at last.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("d"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null and d is not null and crc32(d) % 4 <> 2").withColumn("k", F.md5("d"))
    rows = rows.withColumn("bucket", F.substring("k", 1, BUCKET_DIGITS))
    counts = rows.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where(F.col("before") < SAMPLE_PER_LANG).groupBy("lang").agg(F.max("bucket").alias("last"))
    close = rows.join(F.broadcast(last), "lang").where("bucket <= last").select("lang", "k", F.xxhash64("text").alias("h"), "text")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("k", "h"))
    chosen = close.select("lang", "k", "h").distinct().withColumn("r", rank).where(F.col("r") <= SAMPLE_PER_LANG)
    return close.join(F.broadcast(chosen), ["lang", "k", "h"]).dropDuplicates(["lang", "r"]).orderBy("lang", "r").select("lang", "text")


def fit(docs: DataFrame) -> Crf | None:
    """A model from the labelled documents of sample()."""
    samples = [(r["lang"], r["text"]) for r in sample(docs).collect() if split_words(r["text"])]
    return train(samples) if samples else None


def _rows(words: list[list[str]], model: Crf, known: dict[str, int], table: list[np.ndarray]) -> tuple[list, list]:
    """Best label and its mean marginal for each text that has words."""
    flat = [w for ws in words for w in ws]
    new = list(set(flat).difference(known))
    if len(known) + len(new) > CACHE_WORDS and known:
        known.clear()
        table[0] = table[0][:0]
        new = list(set(flat))
    if new:
        base = len(known)
        known.update(zip(new, range(base, base + len(new))))
        fresh = [model.potentials(new[i : i + 100_000]).astype(np.float32) for i in range(0, len(new), 100_000)]
        table[0] = np.concatenate([table[0], *fresh])
    lens = np.fromiter(map(len, words), np.int64, len(words))
    at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    post = model.marginals(table[0][at], lens)
    mean = np.add.reduceat(post.astype(np.float64), np.cumsum(lens) - lens, axis=0) / lens[:, None]
    best = mean.argmax(axis=1)
    return best.tolist(), np.clip(mean[np.arange(len(best)), best], 0, 1).tolist()


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        known: dict[str, int] = {}
        table = [np.empty((0, len(crf.labels) if crf else 1), np.float32)]
        for b in batches:
            labels, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            todo: list[tuple[int, list[str]]] = []
            held = 0

            def settle() -> None:
                for (i, _), k, s in zip(todo, *_rows([w for _, w in todo], crf, known, table)):
                    labels[i], scores[i] = crf.labels[k], s

            for i, t in enumerate(b.column("text") if crf else ()):
                ws = split_words(t.as_py())
                if ws:
                    todo.append((i, ws))
                    held += len(ws)
                if held >= BATCH_WORDS:
                    settle()
                    todo, held = [], 0
            if todo:
                settle()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(labels), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
