"""Tables kept in the shared folder while an operator works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.scratch import scratch_path


class Scratch:
    """Tables written as Parquet under ``spark.checkpoint.dir`` and read again; gone at the end of the ``with``.

    What the caller returns must not read them any more: keep it with ``result``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            self.drop(path)

    def drop(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def result(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "llm")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, computed once; lost executors lose nothing of them."""
        path = scratch_path(self.spark, "llm")
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
