"""A corpus pipeline of five stages, each one of the operators in carbonloom.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carbonloom.llm import boosted_rules, jaccard_join, line_dedup, mixing, tree_bpe
from carbonloom.llm.common import discard, read, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return boosted_rules.judge(spark, docs, read(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    out = line_dedup.drop_shared_lines(spark, docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id.

    Texts that share a doc_id are judged each by itself, so that the groups are of keys of doc_id and text; of one
    doc_id the lower key stays. Rows without doc_id all stay.
    """
    keyed = docs.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(11), "doc_id", F.coalesce("text", F.lit("")))))
    groups = jaccard_join.near_duplicates(spark, keyed.select(F.col("key").alias("doc_id"), "text"))
    linked = table(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("key"), "component_id").distinct(), "near-linked")
    members = linked.unionByName(linked.select(F.col("component_id").alias("key"), "component_id").distinct())
    members = table(keyed.select("key", "doc_id").distinct().join(members, "key"), "near-members")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.key")
    gone = members.select("key").join(first, "key", "left_anti")
    return keyed.join(gone, "key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that share a doc_id are documents of their own.

    Decisions come back by a key of the whole row. Rows that are equal throughout share out the sum of their copies.
    """
    key, cells = ["row_k1", "row_k2"], [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    keyed = docs.withColumns({k: F.xxhash64(F.lit(n), *cells) for n, k in enumerate(key)})
    copies = mixing.mix(spark, keyed, carry=tuple(key)).groupBy(*key).agg(F.sum("mix_copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    nth = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*key)))
    share = F.floor(F.col("copies") * F.col("nth") / F.col("rows")) - F.floor(F.col("copies") * (F.col("nth") - 1) / F.col("rows"))
    taken = nth.join(copies, key).withColumn("share", share.cast("int")).where("share > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("share")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of them and of what they decode to."""
    out = tree_bpe.encode(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("bpe_ids") / 4).cast("long").alias("n_tokens"), F.sha2("bpe_ids", 256).alias("ids_sha256"), F.sha2("bpe_decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix), ("BPE encoding", encode)]

#: Boosted trees and byte-pair encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
