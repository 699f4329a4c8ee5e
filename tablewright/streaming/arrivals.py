"""Files taken up as they arrive, each once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col
from tablewright.operators.reshape import partition_by
from tablewright.operators.validate import flag_valid
from tablewright.sources.scratch import file_system, remove

Handler = Callable[[DataFrame, int], None]


def arriving_files(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet",
                   pattern: str = "*", archive: str | None = None, **options) -> DataFrame:
    """A stream of the rows of new files with the file's path and name beside them.
    Files done with are moved to ``archive`` if it is given."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern).options(**options)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).withColumns({"event_file_path": F.col("_metadata.file_path"),
                                            "event_file_name": F.col("_metadata.file_name")})


def run_available(stream: DataFrame, handler: Handler, checkpoint: str) -> None:
    """Handle everything that has arrived and stop. The checkpoint folder lets the next run,
    or a run after a failure, go on where this one ended."""
    query = (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def append_to(path: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> Handler:
    """Write each batch, after ``step``, to its own folder; a batch run twice replaces itself."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def route_valid(rules: list[dict], path: str) -> Handler:
    """Valid and quarantined rows in one pass, as ``by_is_valid=true`` and ``by_is_valid=false``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        partition_by(flag_valid(batch, rules), ["is_valid"], f"{path}/batch={batch_id}")

    return handle


Apply = Callable[[DataFrame | None, DataFrame], DataFrame]


BUCKET = "__bucket"


def maintain(path: str, apply: Apply, keys: Sequence[str] = (), buckets: int = 64) -> Handler:
    """Keep a Parquet table by ``apply(table, batch)``: delta, upsert or history.

    With ``keys`` the table is partitioned by a bucket, a hash of them; a batch reads the buckets its
    keys fall into and writes those by dynamic partition overwrite, the others stay as they are.
    ``apply`` must then go key by key, as an upsert does. Without keys there is one bucket.

    A batch that failed comes again and is applied to a table that may hold some of its buckets
    already, so ``apply`` must come to the same with a batch it has seen, as an upsert does.
    """
    def bucketed(df: DataFrame) -> DataFrame:
        draw = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(buckets)).cast("int") if keys else F.lit(0)
        return df.withColumn(BUCKET, draw)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        system, place = file_system(spark, path)
        before = spark.read.parquet(path) if system.exists(place) else None
        # one number for each bucket at most
        touched = [r[0] for r in bucketed(batch).select(BUCKET).distinct().collect()] if keys else [0]
        old = before.filter(F.col(BUCKET).isin(touched)).drop(BUCKET) if before is not None else None
        seen = Observation()
        result = bucketed(apply(old, batch))
        counts = [F.count_if(F.col(BUCKET) == b).alias(f"b{b}") for b in touched] or [F.count(F.lit(1)).alias("none")]
        result.observe(seen, *counts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        # a bucket that lost all its rows is not written, so it goes by itself
        for b in touched:
            if not seen.get[f"b{b}"]:
                remove(spark, f"{path}/{BUCKET}={b}")
        if not any(f.isDirectory() for f in system.listStatus(place)):
            result.drop(BUCKET).limit(0).write.parquet(f"{path}/{BUCKET}=0")  # a table without rows has its columns still

    return handle


def kept_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`maintain` keeps."""
    return spark.read.parquet(path).drop(BUCKET)


def drop_repeats(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """A stream without rows whose keys came before, within ``delay`` of the latest ``time`` seen.

    Keys are forgotten once the watermark has passed them, so the state is as large as what
    ``delay`` holds, not as the stream; rows later than the watermark are left out.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
