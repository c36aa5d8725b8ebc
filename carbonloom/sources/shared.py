"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where that is unset, a session whose executors are threads of this machine (local tests) gets a temporary
    folder; any other session is an error, as its executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="carbonloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def spread(rows: DataFrame, least_bytes: int = 4 << 20) -> DataFrame:
    """rows of a scan, dealt out over the cores where it is of some size but comes in fewer parts than there are cores.

    A file of one row group is one task, however costly what follows is for each row. Larger inputs come in parts
    enough and are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) < least_bytes or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once into the shared folder and read back: what is read several times is computed once, and a lost executor loses nothing."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing still to be computed reads."""
    for rows in frames:
        spark = rows.sparkSession
        for path in {str(f).rsplit("/", 1)[0] for f in rows.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
