"""Joins, aggregates, order and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.aggregates import (count_by, groupby, histogram, histogram_quantiles, merge_sketches, metric, sketched_counts,
                                              unique_sketch)
from tablewright.operators.joins import join, lookup
from tablewright.operators.ordering import deduplicate, head, numbered, sort, top_groups
from tablewright.operators.profile import profile, schema_check
from tablewright.plans.registry import query, table
from tablewright.sources.files import preview

# --- joins ---------------------------------------------------------------------------

ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("join_inner", """
    select o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey from orders join customer on o_custkey = c_custkey""")
def _(spark, folder):
    return join(table(spark, folder, "orders").select(*ORDER),
                table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey")


@query("join_left", """
    select d.doc_id, lang, source, n_chars, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id""")
def _(spark, folder):
    return join(table(spark, folder, "documents").drop("text"), table(spark, folder, "labels"), "doc_id", how="left")


FINISHED = """(select o_custkey as id, o_orderpriority as level, count(*) as n, max(o_totalprice) as top from orders
               where o_orderstatus {0} 'F' group by 1, 2)"""


@query("join_outer", f"""
    select coalesce(a.id, b.id) as id, coalesce(a.level, b.level) as level, a.n, a.top, b.n as n_right, b.top as top_right
    from {FINISHED.format('=')} a full join {FINISHED.format('<>')} b on a.id = b.id and a.level = b.level""")
def _(spark, folder):
    orders, finished = table(spark, folder, "orders"), F.col("o_orderstatus") == "F"

    def summary(condition):
        return (orders.filter(condition).groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("level"))
                .agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")))

    return join(summary(finished), summary(~finished), ["id", "level"], how="outer")


@query("lookup", """
    select l_orderkey, l_linenumber, l_partkey, l_quantity, p_brand from lineitem left join part on l_partkey = p_partkey""")
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lookup(lines, table(spark, folder, "part"), "l_partkey", "p_partkey", "p_brand")


# --- aggregates ----------------------------------------------------------------------

for _op, _sql in [("sum", "round(sum(l_extendedprice), 2)"), ("mean", "round(avg(l_extendedprice), 4)"),
                  ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("count", "count(l_extendedprice)")]:
    @query(f"groupby_{_op}", f"select l_returnflag, {_sql} as l_extendedprice_{_op} from lineitem group by 1")
    def _(spark, folder, op=_op):
        result = groupby(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", op)
        digits = {"sum": 2, "mean": 4}.get(op)
        name = f"l_extendedprice_{op}"
        return result.withColumn(name, F.round(name, digits)) if digits else result


@query("groupby_multi", """
    select nullif(l_returnflag, 'N') as flag, l_linestatus, sum(l_quantity) as l_quantity_sum from lineitem group by 1, 2""")
def _(spark, folder):
    flagged = table(spark, folder, "lineitem").withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("N")))
    return groupby(flagged, ["flag", "l_linestatus"], "l_quantity", "sum")


for _op, _sql in [("sum", "sum(l_quantity)"), ("mean", "round(avg(l_quantity), 6)"), ("min", "min(l_quantity)"),
                  ("max", "max(l_quantity)"), ("count", "count(l_quantity)")]:
    @query(f"metric_{_op}", f"select {_sql} as value from lineitem")
    def _(spark, folder, op=_op):
        result = metric(table(spark, folder, "lineitem"), "l_quantity", op)
        return result.select(F.round("value", 6).alias("value")) if op == "mean" else result


def _flag(spark, folder):
    return table(spark, folder, "lineitem").select(F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"))


@query("metric_null_count", "select count(*) as value from lineitem where l_returnflag = 'N'")
def _(spark, folder):
    return metric(_flag(spark, folder), "flag", "null_count")


@query("metric_n_unique", "select count(distinct l_returnflag) as value from lineitem")
def _(spark, folder):
    return metric(_flag(spark, folder), "flag", "n_unique")


@query("metric_match_regex", "select count(*) as value from lineitem where regexp_matches(nullif(l_returnflag, 'N'), '^[AB]')")
def _(spark, folder):
    return metric(_flag(spark, folder), "flag", "match_regex", pattern="^[AB]")


@query("metric_non_match_regex",
       "select count(*) as value from lineitem where not regexp_matches(nullif(l_returnflag, 'N'), '^[AB]')")
def _(spark, folder):
    return metric(_flag(spark, folder), "flag", "non_match_regex", pattern="^[AB]")


@query("metric_limit", """
    select sum(l_quantity) as value from (
        select l_quantity from lineitem order by l_extendedprice, l_orderkey, l_linenumber, l_quantity limit 1000)""")
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity")
    return metric(lines, "l_quantity", "sum", limit_rows=1000, order_by=["l_extendedprice"])


@query("events_by_type", "select event_type, user_id, count(*) as n from events group by 1, 2")
def _(spark, folder):
    return count_by(table(spark, folder, "events"), ["event_type", "user_id"])


@query("topk_groups", "select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 10")
def _(spark, folder):
    return top_groups(table(spark, folder, "events"), ["user_id"], 10)


BOUNDS = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0]


@query("histogram_buckets", "with t as (select event_type, value from events)" + " union all ".join(
    f"""select event_type, '{b}' as le, count(*) filter (where value <= {b}) as bucket_count, count(value) as total,
        round(sum(value), 2) as total_sum from t group by 1""" for b in BOUNDS) + """
    union all select event_type, '+Inf', count(value), count(value), round(sum(value), 2) from t group by 1""")
def _(spark, folder):
    return histogram(table(spark, folder, "events"), "value", ["event_type"]).withColumn(
        "total_sum", F.round("total_sum", 2))


WIDE = [1.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def _quantile_sql(q: float, alias: str) -> str:
    return f"""round(case when (select max(le) from c c2 where c2.event_type = g.event_type and c2.n >= {q} * g.total) is null
        then {WIDE[-1]} else (select min_by(lo + (le - lo) * ({q} * g.total - prev) / nullif(n - prev, 0), le)
        from c c2 where c2.event_type = g.event_type and c2.n >= {q} * g.total) end, 6) as {alias}"""


@query("latency_quantiles", "with b as (" + " union all ".join(
    f"""select event_type, {WIDE[i]} as le, {WIDE[i - 1] if i else 0.0} as lo, count(*) filter (where value <= {b}) as n,
        {f'count(*) filter (where value <= {WIDE[i - 1]})' if i else '0'} as prev from events group by 1"""
    for i, b in enumerate(WIDE)) + """), c as (select event_type, le, lo, n, prev from b),
    g as (select event_type, count(value) as total from events group by 1)
    select event_type, """ + ", ".join(_quantile_sql(q, a) for q, a in [(0.5, "p50"), (0.95, "p95"), (0.99, "p99")]) + " from g")
def _(spark, folder):
    result = histogram_quantiles(table(spark, folder, "events"), "value", [0.5, 0.95, 0.99], ["event_type"], WIDE)
    return result.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


# --- profile and header --------------------------------------------------------------

PROFILED = {"c_name": "c_name", "c_acctbal": "cast(c_acctbal as varchar)",
            "segment": "coalesce(nullif(c_mktsegment, 'BUILDING'), '')"}


@query("profile", " union all ".join(f"""
    select '{name}' as "column", case when count(try_cast(x as double)) > 0 then 'numeric' else 'text' end as type,
           count(*) as total_rows, count(*) filter (where trim(x) = '') as nulls,
           round(count(*) filter (where trim(x) = '') * 100.0 / count(*), 1) as null_pct, count(distinct x) as uniques,
           min(try_cast(x as double)) as min, max(try_cast(x as double)) as max,
           round(avg(try_cast(x as double)), 2) as mean, round(stddev_pop(try_cast(x as double)), 2) as std,
           array_to_string(list_sort(list_distinct(list(x)))[1:5], '|') as samples
    from (select {sql} as x from customer)""" for name, sql in PROFILED.items()))
def _(spark, folder):
    columns = table(spark, folder, "customer").select(
        "c_name", "c_acctbal", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return profile(columns).withColumn("samples", F.array_join("samples", "|"))


@query("schema_check", """
    select count(*) as table_rows, false as ok, 's_suppkey,s_name,s_nationkey,s_acctbal' as actual,
           's_suppkey,s_name,missing_col' as expected, 'missing_col' as missing, 's_nationkey,s_acctbal' as extra
    from supplier""")
def _(spark, folder):
    suppliers = table(spark, folder, "supplier")
    report = schema_check(suppliers, '["s_suppkey", "s_name", "missing_col"]')
    return suppliers.agg(F.count("*").alias("table_rows")).select("table_rows", *[
        F.lit(",".join(v) if isinstance(v, list) else v).alias(k) for k, v in report.items()])


# --- order and duplicates ------------------------------------------------------------

SORTED = "l_orderkey, l_linenumber, l_extendedprice, l_shipdate"


def _sortable(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate",
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("q"))


SORT_SQL = """with t as (select l_orderkey, l_linenumber, l_extendedprice, l_shipdate,
                                case when l_quantity > 5 then l_quantity end as q from lineitem)
    select *, row_number() over (order by q {0} nulls last, l_orderkey, l_linenumber, l_extendedprice, l_shipdate)
    as position from t"""


@query("sort_asc", SORT_SQL.format("asc"))
def _(spark, folder):
    return numbered(sort(_sortable(spark, folder), "q"))


@query("sort_desc", SORT_SQL.format("desc"))
def _(spark, folder):
    return numbered(sort(_sortable(spark, folder), "q", descending=True))


@query("preview_topn", """
    select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice, o_orderkey, o_custkey limit 10""")
def _(spark, folder):
    return head(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 10, ["o_totalprice"])


@query("first_rows_long", """
    select l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey from lineitem
    order by l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 5000""")
def _(spark, folder):
    return head(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey"), 5000, ["l_returnflag", "l_orderkey"])


@query("metric_n_unique_approx", "select true as within, true as merged")
def _(spark, folder):
    """The estimate is within 2 % of the exact number, and sketches of parts say the same as one of all rows."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag")
    near = metric(lines, "l_orderkey", "approx_n_unique").select(F.col("value").alias("near"))
    exact = metric(lines, "l_orderkey", "n_unique").select(F.col("value").alias("exact"))
    parts = sketched_counts(merge_sketches(unique_sketch(lines, "l_orderkey", ["l_returnflag"])), out="parts")
    found = near.unionByName(exact, True).unionByName(parts, True).agg(*[F.max(c).alias(c) for c in ("near", "exact", "parts")])
    return found.select((F.abs(F.col("near") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within"),
                        (F.abs(F.col("parts") - F.col("near")) <= 0.005 * F.col("exact")).alias("merged"))


@query("preview_any", "select 10 as n, 10 as there")
def _(spark, folder):
    """Any ten rows, all of the table."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    some = preview(orders, 10)
    return some.agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("o_totalprice").isNotNull()).cast("int").alias("there"))


DEDUP_SQL = """select l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey from (
    select *, row_number() over (partition by l_orderkey, l_linenumber
                                 order by l_extendedprice {0}, l_partkey {0}, l_suppkey {0}) as rn from lineitem)
    where rn = 1"""


def _keyed(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey",
                                                   "l_suppkey")


@query("dedup_first", DEDUP_SQL.format("asc"))
def _(spark, folder):
    return deduplicate(_keyed(spark, folder), ["l_orderkey", "l_linenumber"], order_by=["l_extendedprice"])


@query("dedup_last", DEDUP_SQL.format("desc"))
def _(spark, folder):
    return deduplicate(_keyed(spark, folder), ["l_orderkey", "l_linenumber"], keep="last", order_by=["l_extendedprice"])


@query("dedup_all", "select distinct l_suppkey, l_returnflag, l_linestatus, l_quantity from lineitem")
def _(spark, folder):
    return deduplicate(table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"))
