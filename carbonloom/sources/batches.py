"""A table of batches, each committed once: a log of small entries says which folders of rows count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = "version long, action string, key string, folder string, rows long"


class Conflict(RuntimeError):
    """Another writer has taken the version in the log."""


class BatchTable:
    """Rows of the given schema under `path`, appended by batches with an idempotency key.

    A batch is written to a folder of its own, then an entry is added to the log as the next version: the file
    appears whole, by a rename that never replaces another. A batch whose key is in the log adds nothing; one that
    stopped before its entry left a folder that nothing reads, and can be repeated. Of two writers that want one version the
    second looks at the log again. Reading takes the folders of the entries behind the last truncation, so that a
    reader sees whole batches only. Any file system that Spark writes to will do, if its renames are atomic.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path, list(partition_by)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._log = f"{path}/_log"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self) -> DataFrame:
        """(version, action, key, folder, rows): all entries."""
        if not self._files().exists(self._path(self._log)):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).option("pathGlobFilter", "*.json").json(self._log)

    def _next(self) -> int:
        return (self.log().agg(F.max("version")).first()[0] or 0) + 1

    def _commit(self, version: int, action: str, key: str | None, folder: str | None, rows: int) -> None:
        files, jvm = self._files(), self.spark._jvm
        ready = self._path(f"{self._log}/.{uuid.uuid4().hex}")
        out = files.create(ready, False)
        out.write(bytearray(json.dumps({"version": version, "action": action, "key": key, "folder": folder, "rows": rows}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(ready.toUri() if ready.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(ready), files.makeQualified(self._path(f"{self._log}/{version:012d}.json")), never)
        except Py4JJavaError as e:
            files.delete(ready, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise

    def committed(self, key: str) -> bool:
        """Whether a batch of this key was ever appended, also before a truncation."""
        return not self.log().where((F.col("action") == "append") & (F.col("key") == key)).isEmpty()

    def append(self, rows: DataFrame, key: str) -> int:
        """Add rows as the batch `key`; the number of rows added, 0 if the batch had been committed already."""
        if self.committed(key):
            return 0
        folder = f"__batch={uuid.uuid4().hex}"
        writer = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{folder}")
        count = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()
        while True:
            version = self._next()
            if self.committed(key):  # by another writer, meanwhile
                self._files().delete(self._path(f"{self.path}/{folder}"), True)
                return 0
            try:
                self._commit(version, "append", key, folder, count)
            except Conflict:
                continue
            return count

    def each_batch(self, name: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream: a micro-batch that is run again adds nothing."""
        return lambda rows, number: self.append(rows, f"{name}/{number}") and None

    def _standing(self) -> DataFrame:
        log = self.log()
        last = log.agg(F.coalesce(F.max(F.when(F.col("action") == "truncate", F.col("version"))), F.lit(0)).alias("last"))
        return log.join(F.broadcast(last), F.lit(True)).where((F.col("version") > F.col("last")) & (F.col("action") == "append"))

    def read(self) -> DataFrame:
        """The rows of all batches since the last truncation, with `batch_key`."""
        found = self._standing().select("folder", "key").collect()  # an entry for each batch
        if not found:
            return self.spark.createDataFrame([], self.schema).withColumn("batch_key", F.lit(None).cast("string"))
        schema = T.StructType([*self.schema, T.StructField("__batch", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{r['folder']}" for r in found])
        keys = self.spark.createDataFrame([(r["folder"].split("=")[1], r["key"]) for r in found], "__batch string, batch_key string")
        return rows.join(keys, "__batch").select(*self.schema.fieldNames(), "batch_key")

    def truncate(self) -> int:
        """Empty the table by an entry in the log; the number of rows that it had. The files stay until vacuum()."""
        while True:
            version, rows = self._next(), self._standing().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            try:
                self._commit(version, "truncate", None, None, rows)
            except Conflict:
                continue
            return rows

    def vacuum(self) -> int:
        """Delete folders that no standing entry names, once no batch is being written; their number."""
        keep = {r["folder"] for r in self._standing().select("folder").collect()}
        files = self._files()
        gone = [f.getPath() for f in files.listStatus(self._path(self.path)) if f.getPath().getName().startswith("__batch=") and f.getPath().getName() not in keep]
        for path in gone:
            files.delete(path, True)
        return len(gone)
