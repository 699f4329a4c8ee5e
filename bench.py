"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then twice; the better time counts. Results are
computed in full and thrown away by Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablewright.operators.anonymize import anonymize
from tablewright.operators.filters import filter_rows
from tablewright.operators.changes import upsert
from tablewright.operators.joins import join
from tablewright.plans import QUERIES
from tablewright.plans.flagship import mean_tax
from tablewright.plans.registry import table
from tablewright.sources.files import read_any, write_any
from tablewright.sources.scratch import scratch_path

# Fixed value: rows per second published for the four-step chain on CSV.
PUBLISHED_ROWS_PER_SEC = 416_000

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "flagship_mean_tax", "filter_gt", "filter_gt_text", "validate_counts", "derive_arith", "clean_all_steps", "type_cast",
    "anon_hash", "anon_mask_email", "join_inner", "join_outer", "lookup", "groupby_sum", "groupby_multi", "metric_n_unique",
    "histogram_buckets", "latency_quantiles", "profile", "filter_gt_date", "roundtrip_csv_documents", "sort_asc", "preview_topn", "first_rows_long", "dedup_first", "dedup_all",
    "merge_union_all", "pivot_sum", "pivot_first", "unpivot_mixed", "explode_delim", "partition_by_columns",
    "chunk_cumulative", "chunk_cumulative_whole", "delta_sync", "table_upsert", "sync_counts", "scd2_result",
    "roundtrip_csv", "convert_parquet_jsonl", "csv_to_json", "extract_links", "text_map", "json_extract_columns",
    "sql_query_pricing", "sql_query_exists", "generate_shapes", "stream_quarantine",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def csv_chain(spark, schema=True):
    """The published chain: CSV in, derive, filter, mean; as a user reads a CSV, without a schema."""
    path = scratch_path(spark, "bench") + ".csv"
    lines = table(spark, FOLDER, "lineitem")
    write_any(lines.repartition(int(CPUS)), path)
    known = {"schema": lines.schema} if schema else {}
    return lambda: mean_tax(read_any(spark, path, **known), "l_extendedprice", "l_quantity")


def shuffled(spark, make):
    """With no side broadcast, as when both are large."""
    def run_so():
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            path = scratch_path(spark, "bench")
            make().write.parquet(path)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        return spark.read.parquet(path).agg(F.count("*"))

    return run_so


def left_join(spark):
    return lambda: join(table(spark, FOLDER, "lineitem"), table(spark, FOLDER, "orders"), "l_orderkey", "o_orderkey", "left")


def upsert_orders(spark):
    orders = table(spark, FOLDER, "orders")
    source = orders.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return lambda: upsert(orders, source, ["o_orderkey"])


def load_chain(spark):
    """Join, filter, anonymize, load."""
    def chain():
        orders = join(table(spark, FOLDER, "orders"), table(spark, FOLDER, "customer"), "o_custkey", "c_custkey")
        hidden = anonymize(filter_rows(orders, "gt", "10000", column="o_totalprice"), {"c_name": "mask"})
        path = scratch_path(spark, "bench")
        hidden.write.parquet(path)
        return spark.read.parquet(path).agg(F.count("*"))

    return chain


def timed(make) -> float:
    times = []
    for _ in range(3):
        start = time.perf_counter()
        run(make())
        times.append(time.perf_counter() - start)
    return round(min(times[1:]), 3)


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-warehouse-"))
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    rows = table(spark, FOLDER, "lineitem").count()
    queries = {}
    for name, make in {"csv_mean_tax": csv_chain(spark, schema=False), "csv_mean_tax_schema": csv_chain(spark),
                       "join_filter_mask_load": load_chain(spark), "join_left_shuffled": shuffled(spark, left_join(spark)),
                       "upsert_shuffled": shuffled(spark, upsert_orders(spark)),
                       **{n: (lambda n=n: QUERIES[n](spark, FOLDER)) for n in HEADLINE}}.items():
        queries[name] = timed(make)
        print(f"{name}: {queries[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec",
                      "queries": queries, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                      "cpus": int(CPUS), "spark": spark.version, "lineitem_rows": rows,
                      "flagship_rows_per_sec": round(rows / queries["flagship_mean_tax"]),
                      "csv_rows_per_sec": round(rows / queries["csv_mean_tax"]),
                      "csv_times_published": round(rows / queries["csv_mean_tax"] / PUBLISHED_ROWS_PER_SEC, 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
