"""One query per operator over its whole table, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from feedtide.llm import (
    bpe, hard_negatives, jaccard_join, line_dedup, mixing, one_bit_search, packing, repeated_bytes, repetition, secret_scan,
    sharding, toxicity, whitening,
)
from feedtide.llm.common import table

#: Production parameters.
SHARD_BYTES = 64 * 1024 * 1024
SEQUENCE_TOKENS = 1024


def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sharding.shard(docs, SHARD_BYTES).select("doc_id", "shard", "depth", "n_bytes", "over_limit")


def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs))


def op3_line_dedup(spark, sf_dir):
    made = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"), "text")


def op4_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_jaccard_join(spark, sf_dir):
    found = jaccard_join.components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_quality_rules(spark, sf_dir):
    return repetition.judge(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer, capacity=SEQUENCE_TOKENS)


def op9_one_bit_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return one_bit_search.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_suffix_array_dedup(spark, sf_dir):
    return repeated_bytes.without_repeats(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), every=50, positives=5, negatives=3, band=(50, 95))


def op13_source_mixing(spark, sf_dir):
    made = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return made.select("row.doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_one_bit_search": op9_one_bit_search,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mixing": op13_source_mixing,
}

ORACLE_SQL = {
    "op1_sharding": f"""
WITH keyed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (
  SELECT d.depth, h >> (60 - d.depth) AS prefix, sum(n_bytes) AS shard_bytes
  FROM keyed, range(61) d(depth) GROUP BY ALL),
leaf AS (
  SELECT k.doc_id, k.n_bytes, k.h, min(s.depth) AS depth
  FROM keyed k JOIN sums s ON s.prefix = k.h >> (60 - s.depth)
  WHERE s.shard_bytes <= {SHARD_BYTES} OR s.depth = 60 GROUP BY ALL)
SELECT l.doc_id, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.h >> (60 - l.depth)), l.depth::INT, '0') END AS shard,
  l.depth::INT AS depth, l.n_bytes, s.shard_bytes > {SHARD_BYTES} AS over_limit
FROM leaf l JOIN sums s ON s.depth = l.depth AND s.prefix = l.h >> (60 - l.depth)
""",
    "op9_one_bit_search": """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding::DOUBLE[]))
    AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM fine q, fine c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
""",
    "op3_line_dedup": r"""
WITH texts AS (
  SELECT DISTINCT doc_id, md5(text) AS digest, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, digest, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM texts),
stops AS (
  SELECT doc_id, digest, i FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  UNION ALL SELECT doc_id, digest, unnest([0, len(lines) + 1]) FROM texts),
gaps AS (SELECT doc_id, digest, i AS a, lead(i) OVER (PARTITION BY doc_id, digest ORDER BY i) AS b FROM stops),
spans AS (
  SELECT doc_id, digest, a AS first, a + 1 AS last FROM gaps WHERE b IS NOT NULL
  UNION SELECT doc_id, digest, b - 1, b FROM gaps WHERE b - a >= 2
  UNION SELECT doc_id, digest, a + 1, b FROM gaps WHERE b - a >= 3),
pieces AS (
  SELECT s.*, array_to_string(lines[first:last], chr(10)) AS piece
  FROM spans s JOIN texts t ON s.doc_id IS NOT DISTINCT FROM t.doc_id AND s.digest = t.digest
  WHERE first >= 1 AND last <= len(lines)),
placed AS (
  SELECT *, first_value({'d': doc_id, 'g': digest, 'f': first}) OVER (
    PARTITION BY piece ORDER BY doc_id IS NULL, doc_id, digest, first) AS a FROM pieces),
gone AS (
  SELECT DISTINCT doc_id, digest, unnest(range(first, last + 1)) AS i FROM placed
  WHERE doc_id IS DISTINCT FROM a.d OR digest <> a.g OR first > a.f + last - first),
kept AS (
  SELECT n.doc_id, n.digest, count(*) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL), '') AS text
  FROM numbered n LEFT JOIN gone g ON n.doc_id IS NOT DISTINCT FROM g.doc_id AND n.digest = g.digest AND n.i = g.i
  GROUP BY n.doc_id, n.digest)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, md5(k.text) AS text_md5, k.text
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(d.text) = k.digest
""",
    "op12_hard_negatives": """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND isfinite(list_sum(embedding::DOUBLE[]))),
pairs AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
    list_inner_product(a.v, o.v)::BIGINT AS score
  FROM fine a JOIN fine o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
found AS (
  SELECT p.*, n.other_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN pairs n USING (anchor_id)
  WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
""",
    "op13_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS digest FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(weight) OVER () AS all_weights, 1.5::DOUBLE * sum(source_size) OVER () AS words,
    coalesce(sum(2 * source_size) OVER below, 0) AS caps_below, coalesce(sum(weight) OVER below, 0) AS weights_below
  FROM sources WINDOW below AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((words - caps_below) / (all_weights - weights_below), weights_below) AS level
  FROM filled WHERE cap >= (words - caps_below) / (all_weights - weights_below) * weight),
targets AS (SELECT source, source_size, least(cap, level * weight) AS target FROM filled, level),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, whole, floor(target - whole * source_size + 0.5)::BIGINT AS rest,
    coalesce(sum(size) OVER (PARTITION BY s.source
      ORDER BY ('0x' || substr(digest, 1, 15))::BIGINT, ('0x' || substr(digest, 16, 15))::BIGINT
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + least(greatest(rest - before, 0), size))::BIGINT AS taken FROM placed
""",
}
