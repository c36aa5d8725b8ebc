"""Queries of the numbered operators over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from carbonloom.llm import boosted_rules, hard_negatives, jaccard_join, license_scan, line_dedup, mixing, near_vectors, pii, pu_quality, suffix_dedup, tree_bpe, weighted_sampling, whitening
from carbonloom.llm.common import read


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pu_quality.score(spark, docs, read(spark, sf_dir, "labels")).drop("text")


def op2_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = tree_bpe.encode(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("bpe_ids") / 4).cast("long").alias("n_tokens"), F.sha2("bpe_ids", 256).alias("ids_sha256"), F.sha2("bpe_decoded", 256).alias("decoded_sha256"))


def _joined_spans(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find(spark, docs)
    counts = [F.size(F.filter("base", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    both = F.array_sort(F.concat("base", "found"))
    return out.select("doc_id", *counts, F.sha2(_joined_spans(F.col("base")), 256).alias("base_sha256"), _joined_spans(both).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_shared_lines(spark, docs, min_docs=10, batches=4)
    return out.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(spark, read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), bound=0.9, probes=4)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), words=5, percent=75)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(spark, docs, weights=(5.0, 2.0, 1.0), budget=1.5, most=2.0)
    taken = F.col("mix_copies") * F.col("mix_size")
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["line"], n["sentence"], n["license"])), ",").alias("notices"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return boosted_rules.judge(spark, docs, read(spark, sf_dir, "labels")).drop("text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark, read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=64, offset=1_000_000, components=16)
    out = out.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op12_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weighted_sampling.with_edits(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), samples=32)
    prints = [weighted_sampling.fingerprint(F.col(c)).alias(n) for c, n in (("signature", "fingerprint"), ("edited_signature", "edited_fingerprint"))]
    return out.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives.mine(spark, rows, scale=256, relabel=7, every=50, positives=5, negatives=3, low=50, high=95)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_pu_quality, op2_tree_bpe, op3_pii, op4_line_dedup, op5_near_vectors, op6_suffix_dedup, op7_jaccard_join, op8_mixing, op9_license_scan, op10_quality_rules, op11_whitening, op12_weighted_sampling, op13_hard_negatives, pipeline)
}

#: DuckDB SQL. A key is a line stripped of ASCII white space with A-Z lower-cased.
_LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (
  SELECT doc_id, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared s USING (key) GROUP BY doc_id"""

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM per),
ahead AS (
  SELECT *, 1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_w,
    row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k FROM weighed
  WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(CAST(rest AS DOUBLE) / left_w, k) AS t FROM ahead WHERE CAST(rest AS DOUBLE) / left_w <= 2.0 * source_size / w),
goal AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, t * w) AS target FROM weighed, level),
classed AS (
  SELECT *, substr(h, 1, 2) AS slice, CASE WHEN length(bin(size)) <= 5 THEN size ELSE length(bin(size)) * 32 + (size >> (length(bin(size)) - 5)) END AS class FROM sized),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice, h, doc_id) AS i FROM classed WHERE size > 0
  UNION ALL SELECT *, 0 AS i FROM classed WHERE size = 0)
SELECT r.doc_id, r.size, g.source_size, g.target,
  CASE WHEN r.size = 0 THEN 0 ELSE CAST(floor(i * round(target / source_size, 9) + 0.5) - floor((i - 1) * round(target / source_size, 9) + 0.5) AS BIGINT) * r.size END AS taken
FROM ranked r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source"""

_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda k: a.x[k] * o.x[k])) AS BIGINT) AS score
  FROM r a JOIN r o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3"""

ORACLE_SQL = {"op4_line_dedup": _LINES, "op8_mixing": _MIX, "op13_hard_negatives": _NEGATIVES}
