"""Shared folder handling and small distributed helpers of the text operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


#: Rows in a batch that goes to a Python worker, where the session doesn't say: whole texts can be long.
ARROW_ROWS = "2000"
#: Bytes of a small table that go to one file, about, and files that it has at least.
FILE_BYTES, FILES = 16 << 20, 2
#: A table is gathered into files only if that is so many times fewer than a shuffle has partitions.
FEWER = 10


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless their path has it already, and keep their batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or getattr(context, "_framewright_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='framewright-')}/framewright", "zip", root, "framewright")
    context.addPyFile(archive)
    context._framewright_shipped = True


class Scratch:
    """A fresh folder under ``spark.checkpoint.dir``, the place that driver and executors share.

    Where it isn't set, a temporary folder serves a local session; a cluster has to
    name one. Tables written here cut lineage: a lost executor costs only the tasks
    it was running. The folder is removed when the JVM ends; ``drop`` removes one table
    as soon as it is no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="framewright-")
            spark.conf.set("spark.checkpoint.dir", base)
        ship(spark)
        self.spark = spark
        self.path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        hadoop_path = self._hadoop(self.path)
        self._fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(hadoop_path)
        self._fs.deleteOnExit(hadoop_path)

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def uri(self, name: str) -> str:
        """The full URI of an entry, scheme included, for readers other than Spark."""
        return self._fs.makeQualified(self._hadoop(f"{self.path}/{name}")).toString()

    def write(self, df: DataFrame, name: str, size: int | None = None) -> DataFrame:
        """Write a table and read it again. size: its bytes, about, where they are known; they decide the number of files, nothing else."""
        df = df if size is None else gathered(df, size)
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._hadoop(f"{self.path}/{name}"), True)


def file_system(uri: str):
    """(pyarrow file system, path) for a URI of a store that executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle that should follow the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def gathered(df: DataFrame, size: int) -> DataFrame:
    """df in as few partitions as ``size`` bytes need, if that is far fewer than a shuffle has.

    A file a partition is hundreds of files of some rows each. Where Hadoop has no
    native library for a local file system, its JVM starts a process for each of them.
    """
    files = max(FILES, -(-size // FILE_BYTES))
    return df.repartition(files) if FEWER * files <= row_tasks(df.sparkSession) else df


def number_within(scratch: Scratch, df: DataFrame, group: str, spread: Column, buckets: int | Column, out: str, order: list[str]) -> DataFrame:
    """Number the rows of each ``group`` gaplessly from 0, without one task per group.

    Each group is spread over ``buckets`` cells by ``spread``; a row's number is
    its rank in its cell plus the rows of the group's earlier cells. The cell
    counts form a table of one row a cell (the caller bounds the number of groups
    and cells), so it may be broadcast.
    """
    cell = df.withColumn("__cell", F.pmod(spread, buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int"))
    counts = cell.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("__g"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start")
    )
    starts = scratch.write(starts, f"starts_{out}")
    rank = F.row_number().over(Window.partitionBy(group, "__cell").orderBy(*order)) - 1
    return (
        cell.withColumn("__rank", rank)
        .join(F.broadcast(starts), (F.col(group) == F.col("__g")) & (F.col("__cell") == F.col("__c")), "left")
        .withColumn(out, (F.col("__rank") + F.col("__start")).cast("long"))
        .drop("__cell", "__rank", "__g", "__c", "__start")
    )
