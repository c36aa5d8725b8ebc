"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonloom.llm import docstats
from carbonloom.llm.common import binary_lists, map_batches

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no classifier sees: crc32 of the id's text divides by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def agreed(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): documents outside the held-out fold whose labels say 0 or 1, and all the same; nulls are not counted."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key) of docs, each different text of a doc_id once."""
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key")).distinct()


def sample(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """At most `most` rows (doc_id, text_key, ...), those with the lowest hash: the same ones at each run."""
    return rows.orderBy(F.xxhash64(F.lit(salt), "doc_id", "text_key"), "doc_id", "text_key").limit(most)


def feature_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns `carry` and the statistics of text: counts array<long>, features array<double>."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [docstats.statistics(x) for x in binary_lists(batch, "text")]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64()))], [*carry, "counts", "features"])

    kept = docs.select(*carry, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return map_batches(kept, each, fields + ", counts array<long>, features array<double>", by="text")


def fetch(docs: DataFrame, rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of sampled texts; rows (doc_id, text_key, value) must be bounded, and as many come back at most."""
    rows = rows.select(F.col("doc_id").alias("sample_id"), F.col("text_key").alias("sample_key"), F.col(value).cast("double").alias("sample_value"))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = own.join(F.broadcast(rows), (F.col("doc_id") == F.col("sample_id")) & (F.col("text_key") == F.col("sample_key")))
    got = feature_rows(found, ["doc_id", "text_key", "sample_value"]).select("doc_id", "text_key", "sample_value", "features")
    got = got.dropDuplicates(["doc_id", "text_key"]).toPandas().sort_values(["doc_id", "text_key"])  # rows that repeat count once
    x = np.array(got["features"].to_list(), dtype=float).reshape(-1, len(docstats.NAMES))
    return x, got["sample_value"].to_numpy(dtype=float)
