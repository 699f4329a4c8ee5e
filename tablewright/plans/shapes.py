"""Union, pivot, unpivot, explode, partitioned output, cumulative parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.chunks import chunk_cumulative
from tablewright.operators.reshape import (explode_column, merge, partition_by, pivot, read_partitioned, split_by,
                                           unpivot)
from tablewright.plans.registry import query, table
from tablewright.sources.scratch import scratch_path


@query("merge_union_all", """
    select c_custkey as id, c_name as name, c_nationkey as nation, c_acctbal as balance from customer
    union all select s_suppkey, s_name, s_nationkey, s_acctbal from supplier
    union all select s_suppkey, s_name, s_nationkey, s_acctbal from supplier""")
def _(spark, folder):
    names = ["id", "name", "nation", "balance"]
    buyers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").toDF(*names)
    sellers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toDF(*names)
    return merge([buyers, sellers, sellers.select("balance", "nation", "name", "id")])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORDERED = "o_orderdate, o_orderkey, o_custkey, o_totalprice"
PIVOT_SQL = {
    "sum": "round(sum(o_totalprice) {0}, 2)", "mean": "round(avg(o_totalprice) {0}, 4)", "min": "min(o_totalprice) {0}",
    "max": "max(o_totalprice) {0}", "count": "nullif(count(o_totalprice) {0}, 0)",
    "first": f"first(o_totalprice order by {ORDERED}) {{0}}", "last": f"last(o_totalprice order by {ORDERED}) {{0}}",
}

for _how, _sql in PIVOT_SQL.items():
    @query(f"pivot_{_how}", "select o_orderstatus, " + ", ".join(
        _sql.format(f"filter (where o_orderpriority = '{p}')") + f' as "{p}"' for p in PRIORITIES)
        + " from orders group by 1")
    def _(spark, folder, how=_how):
        orders = table(spark, folder, "orders").select(
            "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
        wide = pivot(orders, ["o_orderstatus"], "o_orderpriority", "o_totalprice", how, order_by=["o_orderdate"],
                     columns=PRIORITIES if how != "sum" else None)
        digits = {"sum": 2, "mean": 4}.get(how)
        return wide.select("o_orderstatus", *[(F.round(F.col(f"`{p}`"), digits) if digits else F.col(f"`{p}`")).alias(p)
                                              for p in PRIORITIES])


@query("unpivot", """
    select s_suppkey, 's_nationkey' as variable, cast(s_nationkey as double) as value from supplier
    union all select s_suppkey, 's_acctbal', s_acctbal from supplier""")
def _(spark, folder):
    return unpivot(table(spark, folder, "supplier"), ["s_suppkey"], ["s_nationkey", "s_acctbal"])


@query("unpivot_mixed", """
    select p_partkey, 'p_name' as field, p_name as cell from part union all select p_partkey, 'p_brand', p_brand from part
    union all select p_partkey, 'p_type', p_type from part
    union all select p_partkey, 'p_size', cast(p_size as varchar) from part
    union all select p_partkey, 'p_retailprice', cast(p_retailprice as varchar) from part""")
def _(spark, folder):
    return unpivot(table(spark, folder, "part"), ["p_partkey"], variable_name="field", value_name="cell")


@query("explode_delim", "select p_partkey, unnest(string_split(p_name, ' ')) as p_name from part")
def _(spark, folder):
    return explode_column(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", " ")


@query("explode_json", "select p_partkey, unnest([p_brand, p_type]) as tags from part")
def _(spark, folder):
    tags = F.concat(F.lit('["'), "p_brand", F.lit('","'), "p_type", F.lit('"]')).alias("tags")
    return explode_column(table(spark, folder, "part").select("p_partkey", tags), "tags")


@query("explode_array", """
    select doc_id, unnest(string_split(text, chr(10))) as line from documents""")
def _(spark, folder):
    lines = F.split("text", "\n").alias("line")
    return explode_column(table(spark, folder, "documents").select("doc_id", lines), "line")


@query("split_by_column", "select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders")
def _(spark, folder):
    path = scratch_path(spark, "split")
    split_by(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"),
             "o_orderstatus", path)
    return read_partitioned(spark, path)


@query("partition_by_columns", """
    select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1, 2""")
def _(spark, folder):
    path = scratch_path(spark, "partition")
    partition_by(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"], path)
    return (read_partitioned(spark, path).groupBy("o_orderstatus", "o_orderpriority")
            .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


CHUNKED = ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"]


@query("chunk_cumulative", """
    with recursive r as (select l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() over (
             partition by l_suppkey order by l_orderkey, l_linenumber, l_quantity) as rn from lineitem),
    f as (select l_suppkey, rn, l_quantity as s, 1 as part_idx from r where rn = 1
          union all
          select r.l_suppkey, r.rn, case when f.s >= 1000 then r.l_quantity else f.s + r.l_quantity end,
                 f.part_idx + case when f.s >= 1000 then 1 else 0 end
          from f join r on r.l_suppkey = f.l_suppkey and r.rn = f.rn + 1)
    select r.l_suppkey, l_orderkey, l_linenumber, l_quantity, part_idx from r join f on r.l_suppkey = f.l_suppkey and r.rn = f.rn""")
def _(spark, folder):
    return chunk_cumulative(table(spark, folder, "lineitem").select(*CHUNKED), "l_quantity", 1000,
                            order_by=["l_orderkey", "l_linenumber"], partition_by=["l_suppkey"])


@query("chunk_cumulative_whole", """
    with recursive c as (select l_orderkey, l_linenumber, l_suppkey, l_quantity, row_number() over w as rn,
                                sum(l_quantity) over (w rows unbounded preceding) as cum from lineitem
                         window w as (order by l_orderkey, l_linenumber, l_suppkey, l_quantity)),
    cuts as (select 0 as k, 0::bigint as rn, 0::double as base
             union all
             select k + 1, (select min(rn) from c where cum >= base + 20000),
                    (select min(cum) from c where cum >= base + 20000) from cuts where base is not null)
    select c.l_suppkey, c.l_orderkey, c.l_linenumber, c.l_quantity, cuts.k + 1 as part_idx
    from c asof join (select * from cuts where rn is not null) cuts on c.rn > cuts.rn""")
def _(spark, folder):
    return chunk_cumulative(table(spark, folder, "lineitem").select(*CHUNKED), "l_quantity", 20000,
                            order_by=["l_orderkey", "l_linenumber", "l_suppkey"])


CHUNKED_TAX = ["l_suppkey", "l_orderkey", "l_linenumber", "l_tax"]


@query("chunk_cumulative_fraction", """
    with recursive r as (select l_suppkey, l_orderkey, l_linenumber, l_tax, l_tax::decimal(18, 2) as v, row_number() over (
             partition by l_suppkey order by l_orderkey, l_linenumber, l_tax) as rn from lineitem),
    f as (select l_suppkey, rn, v as s, 1 as part_idx from r where rn = 1
          union all
          select r.l_suppkey, r.rn, (case when f.s >= 0.5 then r.v else f.s + r.v end)::decimal(18, 2),
                 f.part_idx + case when f.s >= 0.5 then 1 else 0 end
          from f join r on r.l_suppkey = f.l_suppkey and r.rn = f.rn + 1)
    select r.l_suppkey, l_orderkey, l_linenumber, l_tax, part_idx from r join f on r.l_suppkey = f.l_suppkey and r.rn = f.rn""")
def _(spark, folder):
    return chunk_cumulative(table(spark, folder, "lineitem").select(*CHUNKED_TAX), "l_tax", 0.5,
                            order_by=["l_orderkey", "l_linenumber"], partition_by=["l_suppkey"], scale=2)


@query("chunk_cumulative_price", """
    with recursive c as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice, row_number() over w as rn,
                                sum(l_extendedprice::decimal(18, 2)) over (w rows unbounded preceding) as cum from lineitem
                         window w as (order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice)),
    cuts as (select 0 as k, 0::bigint as rn, 0::decimal(38, 2) as base
             union all
             select k + 1, (select min(rn) from c where cum >= base + 20000000.01),
                    (select min(cum) from c where cum >= base + 20000000.01) from cuts where base is not null)
    select c.l_suppkey, c.l_orderkey, c.l_linenumber, c.l_extendedprice, cuts.k + 1 as part_idx
    from c asof join (select * from cuts where rn is not null) cuts on c.rn > cuts.rn""")
def _(spark, folder):
    prices = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return chunk_cumulative(prices, "l_extendedprice", 20000000.01, order_by=["l_orderkey", "l_linenumber", "l_suppkey"], scale=2)
