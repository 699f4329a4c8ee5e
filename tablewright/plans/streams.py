"""File-arrival streams run until nothing is left to read."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tablewright.operators.changes import upsert
from tablewright.operators.filters import filter_rows
from tablewright.plans.registry import query, table
from tablewright.sources.scratch import scratch_path
from tablewright.streaming.arrivals import (append_to, arriving_files, drop_repeats, kept_table, maintain, route_valid,
                                            run_available)


def land(df, folder):
    """Files for a stream to find."""
    df.write.mode("append").parquet(folder)


@query("stream_ingest", "select o_orderkey, o_custkey, o_totalprice, true as named from orders")
def _(spark, folder):
    base = scratch_path(spark, "stream")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    land(orders, f"{base}/in")
    stream = arriving_files(spark, f"{base}/in", orders.schema, pattern="*.parquet", archive=f"{base}/processed",
                            maxFilesPerTrigger=1)
    run_available(stream, append_to(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("event_file_name").endswith(".parquet").alias("named"))


@query("stream_filter", "select o_orderkey, o_totalprice from orders where o_totalprice >= 250000")
def _(spark, folder):
    base = scratch_path(spark, "stream")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    land(orders, f"{base}/in")
    stream = filter_rows(arriving_files(spark, f"{base}/in", orders.schema), "gte", "250000", column="o_totalprice")
    run_available(stream.select("o_orderkey", "o_totalprice"), append_to(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("o_orderkey", "o_totalprice")


@query("stream_quarantine", """
    select event_id, event_type, value, value >= 5 and event_type <> 'error' as is_valid from events""")
def _(spark, folder):
    base = scratch_path(spark, "stream")
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    land(events, f"{base}/in")
    rules = [{"column": "value", "operator": ">=", "value": 5}, {"column": "event_type", "operator": "!=", "value": "error"}]
    run_available(arriving_files(spark, f"{base}/in", events.schema), route_valid(rules, f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(
        "event_id", "event_type", "value", F.col("is_valid").cast("boolean"))


LATEST = "max_by(o_totalprice, (o_totalprice, o_orderkey)) filter (where o_orderstatus = '{0}')"


@query("stream_upsert", f"""
    select o_custkey as id, coalesce({LATEST.format('O')}, {LATEST.format('F')}, {LATEST.format('P')}) as price
    from orders group by 1""")
def _(spark, folder):
    base = scratch_path(spark, "stream")
    orders = table(spark, folder, "orders")

    def apply(before, batch):
        latest = batch.select("id", "price", "o_orderkey")
        empty = latest.limit(0) if before is None else before
        return upsert(empty, latest, ["id"], order_by=["price", "o_orderkey"])

    for status in ("P", "F", "O"):
        rows = orders.filter(F.col("o_orderstatus") == status).select(
            F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderkey")
        land(rows, f"{base}/in")
        run_available(arriving_files(spark, f"{base}/in", rows.schema), maintain(f"{base}/table", apply, keys=["id"], buckets=16),
                      f"{base}/checkpoint")
    return kept_table(spark, f"{base}/table").select("id", "price")


@query("stream_resume", "select o_orderkey, o_totalprice from orders")
def _(spark, folder):
    """Half of the files are taken, a run fails on the rest, and the next one goes on: every row once."""
    base = scratch_path(spark, "stream")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    keep = append_to(f"{base}/out", lambda df: df.select("o_orderkey", "o_totalprice"))

    def broken(batch, batch_id):
        keep(batch, batch_id)
        raise RuntimeError("lost")

    land(orders.filter("o_orderkey % 2 = 0"), f"{base}/in")
    run_available(arriving_files(spark, f"{base}/in", orders.schema), keep, f"{base}/checkpoint")
    land(orders.filter("o_orderkey % 2 <> 0"), f"{base}/in")
    try:
        run_available(arriving_files(spark, f"{base}/in", orders.schema), broken, f"{base}/checkpoint")
    except StreamingQueryException:
        run_available(arriving_files(spark, f"{base}/in", orders.schema), keep, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("o_orderkey", "o_totalprice")


@query("stream_dedup", "select event_id, event_type, value from events")
def _(spark, folder):
    base = scratch_path(spark, "stream")
    events = table(spark, folder, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    land(events, f"{base}/in")
    land(events.filter("event_id % 3 = 0"), f"{base}/in")
    stream = arriving_files(spark, f"{base}/in", events.schema, maxFilesPerTrigger=1)
    once = drop_repeats(stream, ["event_id"], "at", "3650 days").select("event_id", "event_type", "value")
    run_available(once, append_to(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type", "value")
