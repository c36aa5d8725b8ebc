"""Operator 4: lines that many documents share, found through levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carbonloom.llm.common import binary_lists, delete, discard, map_batches, table, without
from carbonloom.sources.shared import shared_folder


def line_hash(line: bytes) -> bytes | None:
    """128-bit hash of a line's key (ASCII white space stripped, A-Z lower-cased); None for an empty key."""
    key = line.strip().lower()
    return xxhash.xxh3_128_digest(key) if key else None


class LineRuns:
    """How many documents hold each line, as sorted runs (h, n) on levels, in the manner of a log-structured merge tree.

    A run is a table bucketed and sorted by h, with one file for each bucket, so that joins with it merge it as it lies:
    no exchange and no sort of a run. add(batch) aggregates the hashes of a batch, takes away by merge anti joins those that
    the runs already know to be frequent, and writes the rest as a run on level 0. As soon as a level has `fan_in` runs they
    are merged into one run of the next level, so each hash is rewritten a logarithmic number of times.
    """

    #: Lets a scan of a bucketed table say that it is sorted.
    SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 2):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def __enter__(self) -> LineRuns:
        self.before = self.spark.conf.get(self.SORTED)
        self.spark.conf.set(self.SORTED, "true")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.SORTED, self.before)
        self._drop([r for level in self.levels for r in level])

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            delete(self.spark, f"{shared_folder(self.spark)}/{name}")
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name)
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        out = self.spark.table(runs[0])
        for name in runs[1:]:
            run = self.spark.table(name).withColumnRenamed("n", "m").hint("merge")
            out = out.join(run, "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def add(self, hashes: DataFrame) -> None:
        """hashes: a row (h) for each document of the batch and each line hash in it."""
        new = hashes.groupBy("h").agg(F.count("*").alias("n"))
        for name in (r for level in self.levels for r in level):
            new = new.join(self.spark.table(name).where(F.col("n") >= self.min_docs).select("h").hint("merge"), "h", "left_anti")
        self.levels[0].append(self._write(new))
        for k, runs in enumerate(self.levels):
            if len(runs) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(runs)))
                self._drop(runs)
                self.levels[k] = []

    def frequent(self) -> DataFrame:
        """Hashes (h) in min_docs documents or more. A hash left out of later batches is in a run that has it above the bound."""
        return self._merged([r for level in self.levels for r in level]).where(F.col("n") >= self.min_docs).select("h")


def document_hashes(docs: DataFrame, batches: int) -> DataFrame:
    """(line_doc, line_text, batch, h): a row for each row of docs and each different line hash in it."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [list({h for line in text.split(b"\n") if (h := line_hash(line))}) for text in binary_lists(batch, "text")]
        take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("line_doc", "line_text")), batch.column("batch").take(take), pa.array([h for x in found for h in x], pa.binary())], ["line_doc", "line_text", "batch", "h"])

    key = [F.col("doc_id").cast("long").alias("line_doc"), F.xxhash64("text").alias("line_text")]
    source = docs.select(*key, F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"), "text")
    return map_batches(source, each, "line_doc long, line_text long, batch int, h binary", by="text")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, min_docs: int = 10, batches: int = 4) -> DataFrame:
    """docs, without the lines whose key is in at least min_docs documents, in all documents that hold them.

    docs needs doc_id and text; its other columns stay. Added: line_count, line_dropped (long). text
    becomes the kept lines joined by \\n. Each row counts as a document, also where doc_id repeats or is
    null. Null or empty text: one empty line, kept. Keys that are empty (blank lines) are never dropped.
    An empty table gives an empty table.
    """
    docs = without(docs, "line_doc", "line_text", "line_hits", "line_count", "line_dropped", "line_hit_doc", "line_hit_text")
    hashes = table(document_hashes(docs, batches), "line-hashes", by="batch")
    with LineRuns(spark, min_docs) as runs:
        for k in range(batches):
            runs.add(hashes.where(F.col("batch") == k))
        frequent = table(runs.frequent(), "frequent-lines")
    hits = hashes.join(frequent, "h", "left_semi").groupBy("line_doc", "line_text").agg(F.collect_set("h").alias("line_hits"))
    hits = table(hits.withColumnsRenamed({"line_doc": "line_hit_doc", "line_text": "line_hit_text"}), "line-hits")
    discard(hashes, frequent)
    joined = docs.withColumns({"line_doc": F.col("doc_id").cast("long"), "line_text": F.xxhash64("text")})
    joined = joined.join(hits, F.col("line_doc").eqNullSafe(F.col("line_hit_doc")) & (F.col("line_text") == F.col("line_hit_text")), "left").drop("line_doc", "line_text", "line_hit_doc", "line_hit_text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, count, dropped = [], [], []
        for text, hits in zip(binary_lists(batch, "text"), batch.column("line_hits").to_pylist(), strict=True):
            lines = text.split(b"\n")
            drop = frozenset(hits or ())
            left = [x for x in lines if line_hash(x) not in drop] if drop else lines
            kept.append(b"\n".join(left))
            count.append(len(lines))
            dropped.append(len(lines) - len(left))
        new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "line_count": pa.array(count, pa.int64()), "line_dropped": pa.array(dropped, pa.int64())}
        return pa.RecordBatch.from_arrays([new[f] if f in new else batch.column(f) for f in names], names)

    names = [*docs.columns, "line_count", "line_dropped"]
    return map_batches(joined, each, T.StructType([*docs.schema.fields, T.StructField("line_count", T.LongType()), T.StructField("line_dropped", T.LongType())]), by="text")
