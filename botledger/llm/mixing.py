"""Mixing sources to target weights: a low-discrepancy schedule over equal-token blocks, in built-in functions.

Each source's documents, in md5 order of doc_id, form a tape of words that is run twice and cut
into equal blocks (BLOCK_WORDS). A golden-ratio sequence of points, one for each slot of the mix, is
mapped through the cumulative targets of the sources: the source a point falls on gives the slot,
and the slot's rank among that source's slots is the block it takes. What a source yields is what
its points drew, within a few blocks of its target (the discrepancy of the sequence grows with the
logarithm of the slots); blocks past the end of a tape don't exist, so nothing is taken more than
MAX_PASSES times. The mix itself is the blocks in order of slots.

Ranks and places on the tape are counts within a chunk or part plus prefix sums over chunks and
parts in two levels, so no window sees all rows of a source.

Edge cases: null and blank texts have size 0 and taken 0; null sources form one source, after
all others; null doc_ids are ordered by their texts' hash; repeated rows are separate documents;
an empty table gives an empty result; columns besides doc_id, text and source are not read by
mix() and carried unchanged, whatever their names, by mix_documents().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from botledger.llm.common import fresh_names, stage_out, words

#: Words in a block, and slots that a mix has at least: where its words are too few for these, blocks are shorter, so that small sources come near their targets too.
BLOCK_WORDS = 32
LEAST_SLOTS = 8192
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a multiple of the words there are.
SHARE = 1.5
#: Times a document may be taken.
MAX_PASSES = 2
#: Below this many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: The points stand on a ring of 2^40 places; the step is the golden ratio's share of it (odd, so every place comes once in a round).
RING_BITS = 40
STEP = 679_535_556_991
#: Slots ranked together, and cells of the lookup from points to sources.
CHUNK = 4096
CELLS = 4096
#: Chunks or parts whose counts are summed together.
LEVEL = 256


def point(slot: str) -> str:
    """SQL of a slot's place on the ring: slot * STEP modulo its size, in halves that don't overflow."""
    half = 1 << RING_BITS // 2
    return f"pmod(({slot} % {half}) * {STEP}L + (({slot} div {half}) % {half}) * {STEP % half}L % {half} * {half}L, {1 << RING_BITS}L)"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(sidx, source, source_size, target, quota, run_lo, run_hi) from (source, size).

    Targets are filled like water: the level at which the uncapped sources share what is
    left by weight. One row per source, so the single-task windows see sources, not documents.
    run_lo and run_hi bound the source's stretch of the ring.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sidx") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("sidx", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("weight", weight)
    cap = (F.col("source_size") * MAX_PASSES).cast("double")
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "sidx")
    everything = W.orderBy("ratio", "sidx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
    )
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    per = per.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).withColumn("quota", F.floor(F.col("target") + 0.5))
    run = F.sum("quota").over(W.orderBy("sidx").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("quota").over(W.orderBy("sidx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ring = lambda c: F.floor(c * F.lit(float(1 << RING_BITS)) / F.greatest(total, F.lit(1))).cast("long")
    return per.withColumn("run_hi", ring(run)).withColumn("run_lo", ring(run - F.col("quota"))).select(
        "sidx", "source", "source_size", "target", "quota", "run_lo", "run_hi"
    )


def _sums_before(counts: DataFrame, at: str, out: str) -> DataFrame:
    """(sidx, at, out): the sum of n over smaller ``at`` of the same sidx, in two levels of windows."""
    fine = counts.withColumn("level", F.expr(f"{at} div {LEVEL}"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy("sidx", "level").agg(F.sum("n").alias("n"))
    coarse = coarse.select("sidx", "level", earlier(W.partitionBy("sidx").orderBy("level")).alias("base"))
    inner = fine.select("sidx", "level", at, earlier(W.partitionBy("sidx", "level").orderBy(at)).alias("inner"))
    return inner.join(coarse, ["sidx", "level"]).select("sidx", at, (F.col("base") + F.col("inner")).alias(out))


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """(slot, sidx, block): the source each slot draws from, and the slot's rank among that source's slots."""
    cell = 1 << RING_BITS
    slots = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot"), F.expr(point("id")).alias("point")).withColumn("cell", F.expr(f"point div {cell // CELLS}"))
    cells = sources.where("run_hi > run_lo").select(
        "sidx", "run_lo", "run_hi", F.explode(F.expr(f"sequence(run_lo div {cell // CELLS}, (run_hi - 1) div {cell // CELLS})")).alias("cell")
    )
    drawn = slots.join(cells, "cell").where("point >= run_lo and point < run_hi").select("slot", "sidx", F.expr(f"slot div {CHUNK}").alias("chunk"))
    before = _sums_before(drawn.groupBy("sidx", "chunk").agg(F.count(F.lit(1)).alias("n")), "chunk", "before")
    ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("sidx", "chunk").orderBy("slot")) - 1).join(before, ["sidx", "chunk"])
    return ranked.select("slot", "sidx", (F.col("before") + F.col("r")).alias("block"))


def _tape(docs: DataFrame, row_hash: str, block_words: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Each row's place on its source's tape (start) and the words that source yields; the schedule; and the words in a block."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.expr(row_hash).alias("row_hash"),
        F.size(words(F.col("text").cast("string"))).cast("long").alias("size"),
    ).withColumn("ord", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("row_hash").cast("string")))))
    rows = stage_out(rows, "mix-rows")
    sources = stage_out(source_targets(rows), "mix-sources")
    totals = sources.agg(F.count(F.lit(1)).alias("n"), F.sum("quota").alias("words")).first()
    few = totals["n"] <= BROADCAST_SOURCES
    total = totals["words"] or 0
    block_words = block_words or max(1, min(BLOCK_WORDS, total // LEAST_SLOTS))
    plan = schedule(sources, (total + block_words // 2) // block_words)
    drawn = plan.groupBy("sidx").agg((F.count(F.lit(1)) * block_words).alias("yield"))
    side = sources.join(F.broadcast(drawn) if few else drawn, "sidx", "left").select(
        "sidx", F.col("source").alias("source_"), "source_size", "target", F.coalesce("yield", F.lit(0)).alias("yield")
    )
    placed = rows.join(F.broadcast(side) if few else side, F.expr("source <=> source_")).drop("source_")
    placed = placed.withColumn("part", F.conv(F.substring("ord", 1, 4), 16, 10).cast("int"))
    parts = _sums_before(placed.groupBy("sidx", "part").agg(F.sum("size").alias("n")), "part", "before")
    inside = W.partitionBy("sidx", "part").orderBy("ord", "size", "row_hash").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("inner", F.sum("size").over(inside) - F.col("size")).join(parts, ["sidx", "part"])
    return placed.withColumn("start", F.col("before") + F.col("inner")), plan, block_words


def _words_drawn(turn: int | str) -> str:
    """SQL of the words of a row that a pass over the tape yields; blocks are drawn in tape order."""
    return f"greatest(0, least(size, yield - (start + {turn} * source_size)))"


def mix(docs: DataFrame, block_words: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, first_slot (the slot that takes the block it starts in, or -1)."""
    tape, plan, block_words = _tape(docs, "xxhash64(text)", block_words)
    rows = tape.select(
        "sidx", F.expr(f"start div {block_words}").alias("block"), "doc_id", "source", "size", "source_size", "target",
        F.expr(" + ".join(_words_drawn(k) for k in range(MAX_PASSES))).alias("taken"),
    )
    return rows.join(plan, ["sidx", "block"], "left").select(
        "doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.col("slot")).otherwise(-1).cast("long").alias("first_slot")
    )


def mix_documents(docs: DataFrame, block_words: int | None = None) -> DataFrame:
    """docs in the order of the mix: a row comes once for each pass that draws at least half of its words, where the block it starts in stands."""
    cols = docs.columns
    key, number, slot, at = fresh_names(docs, "key", "number", "slot", "at")
    whole = "xxhash64(" + ", ".join(f"`{c}`" for c in cols) + ")"  # rows alike in every column are one row with several copies
    tape, plan, block_words = _tape(docs, whole, block_words)
    passes = tape.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1)))).where(f"size > 0 and 2 * {_words_drawn('pass')} >= size")
    passes = passes.withColumn("at", F.expr("start + pass * source_size")).withColumn("block", F.expr(f"at div {block_words}"))
    copies = passes.select("sidx", "block", F.col("row_hash").alias(key), F.coalesce("doc_id", F.lit(-1)).alias(number), F.col("at").alias(at))
    copies = copies.join(plan, ["sidx", "block"]).select(key, number, at, F.col("slot").alias(slot))
    keyed = docs.withColumns({key: F.expr(whole), number: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))}).dropDuplicates([key, number])
    return keyed.join(copies, [key, number]).orderBy(slot, at).select(*cols)
