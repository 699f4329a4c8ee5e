"""Row-local operators: filters, validation, cleaning, casts, masking, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.anonymize import anonymize
from tablewright.operators.clean import clean, derive, drop_na, fill_na, if_else, rename, type_cast
from tablewright.operators.filters import filter_rows
from tablewright.operators.template import render_template
from tablewright.operators.validate import rule_condition, validate, validation_counts
from tablewright.plans.registry import query, table

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"
LINE_COLS = [c.strip() for c in LINE.split(",")]


def line(spark, folder, *more):
    return table(spark, folder, "lineitem").select(*LINE_COLS, *more)


def flag_without_n(spark, folder):
    return line(spark, folder, F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"))


# --- filters -------------------------------------------------------------------------

@query("filter_equals", f"select {LINE}, l_returnflag from lineitem where trim(l_returnflag) = 'R'")
def _(spark, folder):
    return filter_rows(line(spark, folder, "l_returnflag"), "equals", "R", column="l_returnflag")


@query("filter_not_equals", f"""
    select {LINE}, nullif(l_returnflag, 'N') as flag from lineitem
    where coalesce(trim(nullif(l_returnflag, 'N')), '') <> 'R'""")
def _(spark, folder):
    return filter_rows(flag_without_n(spark, folder), "not_equals", "R", column="flag")


for _name, _op, _value, _condition in [
        ("filter_contains", "contains", "widget", "contains(trim(p_name), 'widget')"),
        ("filter_not_contains", "not_contains", "ing", "not contains(trim(p_name), 'ing')"),
        ("filter_starts_with", "starts_with", "red", "starts_with(trim(p_name), 'red')"),
        ("filter_ends_with", "ends_with", "bolt", "ends_with(trim(p_name), 'bolt')"),
        ("filter_regex", "regex", "^(red|blue).*[gt]$", "regexp_matches(trim(p_name), '^(red|blue).*[gt]$')")]:
    @query(_name, f"select * from part where {_condition}")
    def _(spark, folder, op=_op, value=_value):
        return filter_rows(table(spark, folder, "part"), op, value, column="p_name")

for _name, _op, _sign in [("filter_gt", "gt", ">"), ("filter_gte", "gte", ">="),
                          ("filter_lt", "less_than", "<"), ("filter_lte", "less_or_equal", "<=")]:
    @query(_name, f"select {LINE} from lineitem where l_quantity {_sign} 25")
    def _(spark, folder, op=_op):
        return filter_rows(line(spark, folder), op, "25", column="l_quantity")

    # The same on cells that are text, some of them no number: those compare as text.
    @query(f"{_name}_text", f"""
        with t as (select o_orderkey, case when o_orderstatus = 'P' then o_orderpriority
                                           else cast(o_custkey as varchar) end as cell from orders)
        select o_orderkey, cell from t
        where case when try_cast(cell as double) is not null then try_cast(cell as double) {_sign} 300
                   else cell {_sign} '300' end""")
    def _(spark, folder, op=_op):
        cell = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
            F.col("o_custkey").cast("string"))
        cells = table(spark, folder, "orders").select("o_orderkey", cell.alias("cell"))
        return filter_rows(cells, op, "300", column="cell")


@query("filter_is_null", f"select {LINE} from lineitem where l_returnflag = 'N'")
def _(spark, folder):
    return filter_rows(flag_without_n(spark, folder), "is_null", column="flag").drop("flag")


@query("filter_is_not_null", f"select {LINE}, l_returnflag as flag from lineitem where l_returnflag <> 'N'")
def _(spark, folder):
    return filter_rows(flag_without_n(spark, folder), "is_not_empty", column="flag")


@query("filter_gt_date", "select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1995-06-17'")
def _(spark, folder):
    return filter_rows(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "gt", "1995-06-17", column="o_orderdate")


@query("filter_equals_int", "select o_orderkey, o_custkey from orders where o_custkey = 7")
def _(spark, folder):
    return filter_rows(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "equals", "7", column="o_custkey")


@query("filter_not_in_int", "select o_orderkey, o_custkey from orders where o_custkey not in (7, 8, 11)")
def _(spark, folder):
    return filter_rows(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "not_in", "7, 8,11,x,08", column="o_custkey")


@query("filter_in", "select * from orders where o_orderstatus in ('F', 'P')")
def _(spark, folder):
    return filter_rows(table(spark, folder, "orders"), "in", "F, P", column="o_orderstatus")


@query("filter_not_in", f"""
    select {LINE}, nullif(l_returnflag, 'N') as flag from lineitem
    where coalesce(nullif(l_returnflag, 'N'), '') not in ('A', 'X')""")
def _(spark, folder):
    return filter_rows(flag_without_n(spark, folder), "not_in", "A, X", column="flag")


@query("filter_by_index", "select * from part where p_brand = 'Brand#17'")
def _(spark, folder):
    return filter_rows(table(spark, folder, "part"), "equals", "Brand#17", column_index=2)


@query("filter_whole_line", """
    select p_partkey, p_name, p_brand, p_type from part
    where contains(cast(p_partkey as varchar) || '|' || p_name || '|' || p_brand || '|' || p_type, 'ring|Brand#2|')""")
def _(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return filter_rows(parts, "contains", "ring|Brand#2|", delimiter="|")


# --- validation ----------------------------------------------------------------------

RULES = [
    {"column": "c_acctbal", "operator": ">=", "value": 0},
    {"column": "c_mktsegment", "operator": "matches", "value": "^[A-H]"},
    {"column": "nation", "operator": "is_not_null"},
]
SOFT_RULES = [*RULES[:2], {"column": "nation", "operator": "<", "value": 20}]
CUSTOMER_SQL = "(select *, nullif(c_nationkey, 3) as nation from customer)"
RULES_SQL = "(c_acctbal >= 0 and regexp_matches(c_mktsegment, '^[A-H]') and nation is not null)"
SOFT_SQL = "(c_acctbal >= 0 and regexp_matches(c_mktsegment, '^[A-H]') and nation < 20)"


def customers(spark, folder):
    return table(spark, folder, "customer").withColumn("nation", F.nullif(F.col("c_nationkey"), F.lit(3)))


@query("validate_valid", f"select * from {CUSTOMER_SQL} where {RULES_SQL}")
def _(spark, folder):
    return validate(customers(spark, folder), RULES)[0]


@query("validate_quarantine", f"select * from {CUSTOMER_SQL} where not {RULES_SQL}")
def _(spark, folder):
    return validate(customers(spark, folder), RULES)[1]


@query("validate_null_rule", f"select * from {CUSTOMER_SQL} where not coalesce({SOFT_SQL}, false)")
def _(spark, folder):
    return validate(customers(spark, folder), SOFT_RULES)[1]


@query("validate_null_rule_dropped", f"select * from {CUSTOMER_SQL} where not {SOFT_SQL}")
def _(spark, folder):
    return validate(customers(spark, folder), SOFT_RULES, null_policy="drop")[1]


@query("validate_counts", f"""
    select count(*) filter (where coalesce({SOFT_SQL}, false)) as valid,
           count(*) filter (where not coalesce({SOFT_SQL}, false)) as quarantined from {CUSTOMER_SQL}""")
def _(spark, folder):
    return validation_counts(customers(spark, folder), SOFT_RULES)


RULE_OPS = {
    "eq_text": ("c_mktsegment", "equals", "BUILDING", "c_mktsegment = 'BUILDING'"),
    "eq_int": ("c_nationkey", "==", 7, "c_nationkey = 7"),
    "ne_text": ("c_mktsegment", "!=", "BUILDING", "c_mktsegment <> 'BUILDING'"),
    "ne_float": ("c_acctbal", "not_equals", 10.5, "c_acctbal <> 10.5"),
    "contains_regex": ("c_mktsegment", "contains", "O.*E", "regexp_matches(c_mktsegment, 'O.*E')"),
    "starts": ("c_mktsegment", "starts_with", "AUTO", "starts_with(c_mktsegment, 'AUTO')"),
    "ends": ("c_name", "ends_with", "7", "ends_with(c_name, '7')"),
    "regex_match": ("c_name", "regex", "0[1-3]$", "regexp_matches(c_name, '0[1-3]$')"),
    "gt": ("c_acctbal", "greater_than", 100.0, "c_acctbal > 100"),
    "ge": ("c_acctbal", "greater_than_or_equal", 0, "c_acctbal >= 0"),
    "lt": ("nation", "<", 5, "nation < 5"),
    "le": ("nation", "less_than_or_equal", 5, "nation <= 5"),
    "null": ("nation", "is_null", None, "nation is null"),
    "not_null": ("nation", "is_not_null", None, "nation is not null"),
}


@query("validate_rule_ops", "select c_custkey, " + ", ".join(
    f"{sql} as r_{name}" for name, (_, _, _, sql) in RULE_OPS.items()) + f" from {CUSTOMER_SQL}")
def _(spark, folder):
    return customers(spark, folder).select("c_custkey", *[
        rule_condition({"column": c, "operator": op, "value": v}).alias(f"r_{name}")
        for name, (c, op, v, _) in RULE_OPS.items()])


# --- cleaning ------------------------------------------------------------------------

@query("derive_arith", f"""
    select {LINE}, l_extendedprice * (1 - l_discount) as net, l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross,
           l_extendedprice / l_quantity as unit, l_linenumber - 1 - 1 as two_less, l_partkey // 10 as bin from lineitem""")
def _(spark, folder):
    prices = table(spark, folder, "lineitem").select(*LINE_COLS, "l_extendedprice", "l_discount", "l_tax")
    made = derive(prices, {
        "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "gross": F.col("net") * (1 + F.col("l_tax")),
        "unit": F.col("l_extendedprice") / F.col("l_quantity"),
        "two_less": "l_linenumber - 1 - 1",
        "bin": "l_partkey div 10",
    })
    return made.select(*LINE_COLS, "net", "gross", "unit", "two_less", "bin")


@query("derive_concat", f"select c_custkey, c_name || ' / ' || cast(nation as varchar) as label from {CUSTOMER_SQL}")
def _(spark, folder):
    label = F.concat("c_name", F.lit(" / "), F.col("nation").cast("string"))
    return derive(customers(spark, folder), {"label": label}).select("c_custkey", "label")


@query("derive_if_else", f"select c_custkey, case when nation < 10 then 'low' else 'rest' end as band from {CUSTOMER_SQL}")
def _(spark, folder):
    band = if_else(F.col("nation") < 10, F.lit("low"), F.lit("rest"))
    return derive(customers(spark, folder), {"band": band}).select("c_custkey", "band")


@query("derive_contains", """
    select p_partkey, case when regexp_matches(p_type, 'S.*L') then p_retailprice * 2 else p_retailprice end as price
    from part""")
def _(spark, folder):
    price = if_else(F.col("p_type").rlike("S.*L"), F.col("p_retailprice") * 2, F.col("p_retailprice"))
    return derive(table(spark, folder, "part"), {"price": price}).select("p_partkey", "price")


@query("clean_select", "select c_name, c_custkey from customer")
def _(spark, folder):
    return clean(table(spark, folder, "customer"), select_columns=["c_name", "c_custkey"])


@query("clean_rename", "select c_custkey as id, c_name as name, c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, folder):
    return rename(table(spark, folder, "customer"), {"c_custkey": "id", "c_name": "name", "absent": "x"})


GAPS = """(select c_custkey, c_name, case when c_acctbal < 0 then null else c_acctbal end as balance,
                  nullif(c_nationkey, 3) as nation, nullif(c_mktsegment, 'BUILDING') as segment from customer)"""


def gaps(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))


@query("clean_fill_na", f"""
    select c_custkey, c_name, coalesce(balance, 0.0) as balance, coalesce(cast(nation as varchar), 'none') as nation,
           coalesce(segment, 'unknown') as segment from {GAPS}""")
def _(spark, folder):
    return fill_na(gaps(spark, folder), {"balance": 0.0, "nation": "none", "segment": "unknown"})


@query("clean_drop_na", f"select * from {GAPS} where balance is not null and nation is not null and segment is not null")
def _(spark, folder):
    return drop_na(gaps(spark, folder))


@query("clean_join", "select c.*, n_name, n_regionkey from customer c left join nation on c_nationkey = n_nationkey")
def _(spark, folder):
    return clean(table(spark, folder, "customer"), right=table(spark, folder, "nation"), left_on="c_nationkey",
                 right_on="n_nationkey", how_join="anything")


@query("clean_all_steps", f"""
    with j as (select g.*, n_name from {GAPS} g left join nation on nation = n_nationkey),
    d as (select *, balance * 0.1 as fee from j),
    f as (select c_name, coalesce(balance, 0.0) as balance, round(coalesce(fee, 0.0), 4) as fee, n_name, segment from d),
    k as (select segment, n_name as country, balance, fee, c_name from f where segment is not null and n_name is not null),
    r as (select *, row_number() over (partition by segment, country order by balance desc, fee desc, c_name desc) as rn
          from k)
    select segment, country, balance, fee, c_name from r where rn = 1""")
def _(spark, folder):
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return clean(gaps(spark, folder), right=nations, left_on="nation", right_on="n_nationkey",
                 derive_columns={"fee": "balance * 0.1"}, fill={"balance": 0.0, "fee": 0.0, "nation": -1},
                 drop_nulls=True, rename_columns={"n_name": "country"},
                 select_columns=["segment", "country", "balance", "fee", "c_name"],
                 dedup_on=["segment", "country"], keep="last", dedup_order=["balance", "fee", "c_name"],
                 sort_by="balance", sort_descending=True).withColumn("fee", F.round("fee", 4))


@query("type_cast", """
    with t as (select o_orderkey, cast(o_orderkey as varchar) || case when o_orderstatus = 'P' then 'x' else '' end as a,
                      cast(o_totalprice as varchar) as b, case when o_orderstatus = 'F' then 'true' else 'false' end as c,
                      o_custkey as d, strftime(o_orderdate, '%d/%m/%Y') as e from orders)
    select o_orderkey, try_cast(a as bigint) as a, cast(b as double) as b, cast(c as boolean) as c,
           cast(d as varchar) as d, cast(strptime(e, '%d/%m/%Y') as date) as e from t""")
def _(spark, folder):
    texts = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "x").otherwise("")).alias("a"),
        F.col("o_totalprice").cast("string").alias("b"),
        F.when(F.col("o_orderstatus") == "F", "true").otherwise("false").alias("c"),
        F.col("o_custkey").alias("d"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("e"))
    return type_cast(texts, {"a": "int", "b": "float", "c": "bool", "d": "str", "e": "date:%d/%m/%Y"})


@query("type_cast_datetime", """
    select event_id, date_trunc('second', ts) as stamp, cast(ts as date) as day from events""")
def _(spark, folder):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    texts = table(spark, folder, "events").select("event_id", text.alias("stamp"), text.alias("day"))
    return type_cast(texts, {"stamp": "datetime:%Y-%m-%d %H:%M:%S", "day": "date"})


# --- masking -------------------------------------------------------------------------

PEOPLE = """(select c_custkey, c_name as name, lower(replace(c_name, '#', '.')) || '@mail.example.com' as email,
                    cast(c_nationkey as varchar) as code, nullif(c_mktsegment, 'BUILDING') as segment from customer)"""
MASK_SQL = ("case when length({0}) <= 2 then repeat('*', length({0})) else "
            "left({0}, 1) || repeat('*', length({0}) - 2) || right({0}, 1) end")


def people(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example.com")).alias("email"),
        F.col("c_nationkey").cast("string").alias("code"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))


@query("anon_replace", f"""
    select c_custkey, '[REDACTED]' as name, case when segment is null then null else '[REDACTED]' end as segment
    from {PEOPLE}""")
def _(spark, folder):
    return anonymize(people(spark, folder), {"name": "replace", "segment": "no such word"}).select(
        "c_custkey", "name", "segment")


FNV_SQL = """
    list_reduce(list_prepend(14695981039346656037::HUGEINT,
                             list_transform(regexp_extract_all(hex(encode({0})), '..'),
                                            lambda p: ('0x' || p)::INT::HUGEINT)),
                lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""
HEX_SQL = "printf('%08x%08x', ({0} // 4294967296)::BIGINT, ({0} % 4294967296)::BIGINT)"


@query("anon_hash", f"""
    with h as (select c_custkey, email, segment, {FNV_SQL.format('name')} as a, {FNV_SQL.format('segment')} as b
               from {PEOPLE})
    select c_custkey, email, {HEX_SQL.format('a')} as name,
           case when segment is null then null else {HEX_SQL.format('b')} end as segment from h""")
def _(spark, folder):
    return anonymize(people(spark, folder), {"name": "hash", "segment": "hash"}).drop("code")


@query("anon_mask", f"""
    select c_custkey, {MASK_SQL.format('name')} as name, {MASK_SQL.format('code')} as code,
           {MASK_SQL.format('segment')} as segment from {PEOPLE}""")
def _(spark, folder):
    return anonymize(people(spark, folder), {"name": "mask", "code": "mask", "segment": "mask"}).drop("email")


@query("anon_mask_email", f"""
    with p as (select c_custkey, left(email, strpos(email, '@') - 1) as front,
                      substr(email, strpos(email, '@')) as rest, name from {PEOPLE})
    select c_custkey, {MASK_SQL.format('front')} || rest as email, {MASK_SQL.format('name')} as name from p""")
def _(spark, folder):
    return anonymize(people(spark, folder), {"email": "mask_email", "name": "mask_email"}).select(
        "c_custkey", "email", "name")


@query("row_template", f"""
    select c_custkey, 'Hello ' || c_name || ' from ' || coalesce(cast(nation as varchar), 'None') || ': ${{unknown}} v1'
           as text from {CUSTOMER_SQL}""")
def _(spark, folder):
    return render_template(customers(spark, folder), "Hello ${c_name} from ${nation}: ${unknown} ${release}", "text",
                           constants={"release": "v1"}).select("c_custkey", "text")
