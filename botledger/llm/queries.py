"""Registered queries op1 to op13 and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botledger.llm import bpe, embed_dedup, hard_negatives, html_extract, language, licenses, line_dedup, mixing, quality, simhash, substring, token_store, tree_lloyd
from botledger.llm.common import table, table_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


@query("op5_mix_sources")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE["op5_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s0),
s2 AS (SELECT *, 2 * n AS cap, 2 * n / w AS ratio FROM s1),
s3 AS (SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, least(cap, w * (SELECT max(level) FROM s3 WHERE level <= ratio)) AS target FROM s3),
s5 AS (SELECT *, floor(target + 0.5) AS quota FROM s4),
s6 AS (SELECT *, sum(quota) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(quota) OVER () AS total FROM s5),
s7 AS (SELECT *, floor((run - quota) * 1099511627776.0::DOUBLE / total) AS lo, floor(run * 1099511627776.0::DOUBLE / total) AS hi FROM s6),
blk AS (SELECT greatest(1, least(32, CAST(coalesce(max(total), 0) AS BIGINT) // 8192)) AS b FROM s6),
points AS (SELECT k AS slot, CAST(k AS HUGEINT) * 679535556991 % 1099511627776 AS point
  FROM range((CAST((SELECT coalesce(max(total), 0) FROM s6) AS BIGINT) + (SELECT b // 2 FROM blk)) // (SELECT b FROM blk)) AS r(k)),
ranked AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM points JOIN s7 ON point >= lo AND point < hi),
yield AS (SELECT source, max(block) + 1 AS blocks FROM ranked GROUP BY source),
t AS (SELECT d.*, CAST(s7.n AS BIGINT) AS source_size, s7.target, coalesce(y.blocks, 0) * (SELECT b FROM blk) AS drawn,
        sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start
      FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source LEFT JOIN yield y ON d.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(0, least(size, drawn - start)) + greatest(0, least(size, drawn - source_size - start)) AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 AND drawn > start THEN r.slot ELSE -1 END AS BIGINT) AS first_slot
FROM t LEFT JOIN ranked r ON t.source IS NOT DISTINCT FROM r.source AND r.block = t.start // (SELECT b FROM blk)
"""


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_digests(table(spark, sf_dir, "documents"))


@query("op4_token_store")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = table_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), folder, bpe.vocabulary_path("word_bpe_49k.json"))
    return token_store.read(spark, folder, digest=True)


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.vocabulary_path("byte_bpe_50k.json"))


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op2_html_extract")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


_WHOLE = "list_transform(embedding, lambda x: CAST(floor({} * CAST(x AS DOUBLE)) AS BIGINT))"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
ORACLE["op11_hard_negatives"] = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE.format(256)} AS v, len(embedding) AS n
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.n = b.n WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, other AS positive, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
w AS (SELECT p.anchor, positive, ps, other, score, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, other AS negative_id, CAST(ps AS BIGINT) AS positive_score, CAST(score AS BIGINT) AS negative_score FROM w WHERE rank <= 10
"""


@query("op12_centroid_clustering")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_lloyd.clustered(table(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    """Three rounds of Lloyd and the last assignment, from the start c0."""
    near = """a{k} AS MATERIALIZED (SELECT vec_id, v, c AS cluster, dist FROM (SELECT e.vec_id, e.v, e.r, c{k}.c,
        list_sum(list_transform(list_zip(e.v, c{k}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM e, c{k}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)"""
    move = """s{k} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{k}) GROUP BY cluster, pos),
      m{k} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM s{k} GROUP BY cluster),
      c{j} AS MATERIALIZED (SELECT c{k}.c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} ON m{k}.cluster = c{k}.c)"""
    return ",\n".join([x for k in range(3) for x in (near.format(k=k), move.format(k=k, j=k + 1))] + [near.format(k=3)])


ORACLE["op12_centroid_clustering"] = f"""
WITH e AS MATERIALIZED (SELECT vec_id, {_WHOLE.format(64)} AS v, row_number() OVER () AS r FROM embeddings WHERE len(embedding) = 64 AND {_USABLE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM e ORDER BY h, v LIMIT 16)),
{_rounds()}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.c = a3.cluster
"""


@query("op13_line_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


ORACLE["op13_line_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, r, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, r, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.top AS gone FROM l LEFT JOIN k ON k.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id
"""
