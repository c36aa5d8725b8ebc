"""What several operators share: intermediate tables, text batches and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carbonloom.sources.shared import shared_folder

#: A word is a run of characters other than space and \t \n \v \f \r; bytes.split() divides UTF-8 just so.
WORD = r"[^\x20\x09-\x0D]+"


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df into the shared folder (in folders by the values of a column) and read it back: it is computed once and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables (as table() returned them) that no frame still to be computed reads."""
    for df in tables:
        delete(df.sparkSession, df.scratch)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_lists(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string or binary column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Hand freed memory back to the machine: Python workers live on from task to task, and what each keeps stands beside the JVM in later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str | None, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices with about `most` bytes of a string or binary column (None: `most` rows), one row at least."""
    size = np.arange(1, batch.num_rows + 1)
    if column:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, by: str | None = None, most: int = 4 << 20) -> DataFrame:
    """each(batch) for all of df, some `most` bytes of the column `by` (None: rows) at once; None makes no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, most):
                if (out := each(part)) is not None:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def text_bytes(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.sum(F.octet_length(df[text])), F.lit(0))


#: Edges that a task joins up.
EDGES_AT_ONCE = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (v, m) to the smallest reachable id instead, among the edges of a task, some EDGES_AT_ONCE of them at a time."""
    parent: dict[int, int] = {}
    edges = 0

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out() -> pa.RecordBatch:
        ids = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["v", "m"])

    for batch in batches:
        if edges and edges + batch.num_rows > EDGES_AT_ONCE:
            yield out()
            parent.clear()
            edges = 0
        for a, b in zip(batch.column("v").to_pylist(), batch.column("m").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        edges += batch.num_rows
    if parent:
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for each id that an edge names. edges: read from a table, as it is read twice.

    There are as many tasks as edges ask for, EDGES_AT_ONCE to each. Each round joins up the edges that lie in one task, then
    takes a large-star and a small-star step over all; it is written out. Rounds end when each id hangs on one root,
    which one task alone reaches at once, and grow with the logarithm of the longest path. Hubs are split by
    the adaptive skew join: no node's neighbours are gathered in one place. Null ends and loops are ignored. What is returned reads a
    table, which discard() deletes.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("v") > F.col("m")))
    tasks = max(1, -(-e.count() // EDGES_AT_ONCE))

    def joined(e: DataFrame) -> DataFrame:
        return table(e.coalesce(tasks).mapInArrow(_stars, "v long, m long"), "edges")

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.col("v").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(e.select("m", F.lit(0), F.lit(1)))
        return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.max("top").alias("top")).where("ups > 1 or ups = 1 and top = 1").isEmpty()

    e = joined(e)
    while tasks > 1 and not settled(e):
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).union(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("least"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.least("u", "least").alias("m"))
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v")
        small = small.select("v", F.col("least").alias("m")).union(small.select(F.col("m").alias("v"), F.col("least").alias("m")))
        before, e = e, joined(small.where("v > m").distinct())
        discard(before)
    roots = e.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
    out = e.select(F.col("v").alias("id"), F.col("m").alias("component")).union(roots)
    out.scratch = e.scratch
    return out
