"""Change capture. Each row sums up the orders of one customer and priority: the target says
what the finished orders say, the source what all the others say."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.changes import delta, scd2, schema_drift_upsert, sync, sync_counts, upsert
from tablewright.operators.drift import union_with_drift
from tablewright.plans.registry import query, table

KEYS = ["id", "level"]
SIDE = """(select o_custkey as id, o_orderpriority as level, cast(max(year(o_orderdate)) as int) as top, count(*) as n
           from orders where o_orderstatus {0} 'F' group by 1, 2)"""
T, S = SIDE.format("="), SIDE.format("<>")
PAST = """(select o_custkey as id, o_orderpriority as level, cast(min(year(o_orderdate)) as int) as top
           from orders group by 1, 2)"""
ABSENT = "not exists (select 1 from {0} x where x.id = {1}.id and x.level = {1}.level)"
SAME = "s.id = t.id and s.level = t.level"


def summary(orders, year=F.max):
    return (orders.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("level"))
            .agg(year(F.year("o_orderdate")).alias("top"), F.count("*").alias("n")))


def both(spark, folder):
    """``(source, target)``"""
    orders = table(spark, folder, "orders")
    return summary(orders.filter(F.col("o_orderstatus") != "F")), summary(orders.filter(F.col("o_orderstatus") == "F"))


@query("delta_upserts", f"select * from {S}")
def _(spark, folder):
    return delta(*both(spark, folder), KEYS).upserts


@query("delta_deletes", f"select * from {T} t where {ABSENT.format(S, 't')}")
def _(spark, folder):
    return delta(*both(spark, folder), KEYS).deletes


@query("delta_sync", f"""
    select * from {S} union all select * from {T} t where {ABSENT.format(S, 't')}""")
def _(spark, folder):
    return delta(*both(spark, folder), KEYS).sync


@query("table_upsert", f"""
    select coalesce(t.id, s.id) as id, coalesce(t.level, s.level) as level, coalesce(s.top, t.top) as top, t.n
    from {T} t full join {S} s on {SAME}""")
def _(spark, folder):
    source, target = both(spark, folder)
    return upsert(target, source.drop("n"), KEYS)


@query("table_upsert_lines", """
    with o as (select o_custkey as id, max_by(o_totalprice, (o_orderdate, o_orderkey)) as price,
                      max_by(o_orderkey, (o_orderdate, o_orderkey)) as okey from orders group by 1)
    select c_custkey as id, c_name as name, coalesce(price, c_acctbal) as amount from customer left join o on id = c_custkey""")
def _(spark, folder):
    target = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                     F.col("c_acctbal").alias("amount"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"),
                                                   "o_orderdate", "o_orderkey")
    return upsert(target, orders, ["id"], order_by=["o_orderdate", "o_orderkey"], schema_drift=True).select(
        "id", "name", "amount")


@query("sync_result", f"select s.id, s.level, t.n, s.top from {S} s left join {T} t on {SAME}")
def _(spark, folder):
    source, target = both(spark, folder)
    return sync(target, source.drop("n"), KEYS).select("id", "level", "n", "top")


@query("sync_counts", f"""
    select count(*) filter (where t.id is null) as inserted, count(*) filter (where t.id is not null and s.id is not null)
           as updated, count(*) filter (where s.id is null) as deleted from {T} t full join {S} s on {SAME}""")
def _(spark, folder):
    source, target = both(spark, folder)
    return sync_counts(target, source, KEYS)


@query("schema_drift_union", f"""
    select id, cast(n as double) as n, cast(top as varchar) as top, null as segment from {T}
    union all select c_custkey, c_acctbal, c_name, c_mktsegment from customer""")
def _(spark, folder):
    target = both(spark, folder)[1].select("id", "n", "top")
    drifted = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("n"),
                                                      F.col("c_name").alias("top"),
                                                      F.col("c_mktsegment").alias("segment"))
    return union_with_drift(target, drifted)


@query("schema_drift_upsert", f"""
    select coalesce(t.id, s.id) as id, coalesce(t.level, s.level) as level, t.top,
           case when s.id is not null then s.n / 2.0 else cast(t.n as double) end as n,
           s.top as latest from {T} t full join {S} s on {SAME}""")
def _(spark, folder):
    source, target = both(spark, folder)
    drifted = source.select(*KEYS, (F.col("n") / 2).alias("n"), F.col("top").alias("latest"))
    return schema_drift_upsert(target, drifted, KEYS)


HISTORY = f"""
    (select id, level, top, '2022-01-01' as valid_from, '2023-01-01' as valid_to, false as is_current from {PAST}
     union all select id, level, top, '2023-01-01', null, true from {T})"""
SCD_SQL = f"""(
    select * from {HISTORY} where not is_current
    union all
    select t.id, t.level, t.top, t.valid_from, case when s.id is null or s.top <> t.top then '2024-01-01' end,
           s.id is not null and s.top = t.top from {HISTORY} t left join {S} s on {SAME} where t.is_current
    union all
    select s.id, s.level, s.top, '2024-01-01', null, true from {S} s
    where not exists (select 1 from {T} t where {SAME} and t.top = s.top))"""


def history(spark, folder):
    source, target = both(spark, folder)
    past = summary(table(spark, folder, "orders"), F.min).select(
        *KEYS, "top", F.lit("2022-01-01").alias("valid_from"), F.lit("2023-01-01").alias("valid_to"),
        F.lit(False).alias("is_current"))
    now = target.select(*KEYS, "top", F.lit("2023-01-01").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
                        F.lit(True).alias("is_current"))
    return scd2(source.drop("n"), past.unionByName(now), KEYS, "2024-01-01")


@query("scd2_result", f"select * from {SCD_SQL}")
def _(spark, folder):
    return history(spark, folder)


@query("scd2_current", f"select * from {SCD_SQL} where is_current")
def _(spark, folder):
    return history(spark, folder).filter("is_current")


@query("scd2_closed", f"select * from {SCD_SQL} where not is_current")
def _(spark, folder):
    return history(spark, folder).filter("not is_current")
