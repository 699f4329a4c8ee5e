"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, set as checkpoint folder too.

    Where the setting is missing a local session gets a temporary folder; on a cluster
    that is an error, as executors could not share it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tablewright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; it does not exist yet."""
    return f"{shared_folder(spark)}/tablewright/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system a path is on, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it; nothing happens if it is not there."""
    system, place = file_system(spark, path)
    system.delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint: the rows and their partitions stay as they are, whatever is lost later."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_place(df: DataFrame, place: str) -> DataFrame:
    """Number the rows, the same numbers whenever a task runs again.

    After a shuffle a partition may bring its rows in another order the second time, so
    each partition is sorted by all columns first; rows that still tie are equal, and either may
    have either number. Rows with columns that cannot be sorted by are fixed on disk instead.
    """
    sortable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    if len(sortable) == len(df.columns):
        cells = [col(c) for c in sortable]
        # By a hash first: one whole number tells nearly all rows apart.
        return df.sortWithinPartitions(F.xxhash64(*cells), *cells).withColumn(place, F.monotonically_increasing_id())
    return cut_lineage(df.withColumn(place, F.monotonically_increasing_id()))
