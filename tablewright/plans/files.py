"""Files, tables, SQL and generated rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewright.operators.generate import add_generated
from tablewright.operators.ordering import with_position
from tablewright.operators.reshape import partition_by
from tablewright.plans.registry import query, table
from tablewright.sources.files import (convert, csv_to_json, file_inventory, json_to_csv, json_to_xml, read_any,
                                       read_sniffed, read_xml, write_any, xml_to_json)
from tablewright.sources.scratch import scratch_path
from tablewright.sources.tables import sql_query, write_table


@query("scan_parquet", "select * from orders")
def _(spark, folder):
    return read_any(spark, f"{folder}/orders.parquet")


CUSTOMER = "select c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') as segment from customer"


def customers(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal",
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))


for _kind in ("csv", "json", "jsonl"):
    @query(f"roundtrip_{_kind}", CUSTOMER)
    def _(spark, folder, kind=_kind):
        path = scratch_path(spark, "roundtrip") + f".{kind}"
        write_any(customers(spark, folder), path)
        return read_any(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "segment")


@query("csv_types", """
    select 'bigint' as event_id, 'double' as value, 'string' as ts, 'boolean' as big, 'string' as props, count(*) as n,
           sum(event_id) as ids, count(*) filter (where value >= 50) as n_big from events""")
def _(spark, folder):
    path = scratch_path(spark, "types") + ".csv"
    events = table(spark, folder, "events")
    write_any(events.select("event_id", "value", "ts", (F.col("value") >= 50).alias("big"), "props"), path)
    back = read_any(spark, path)
    kinds = [F.lit(kind).alias(name) for name, kind in back.dtypes]
    return back.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count_if("big").alias("n_big")).select(
        *kinds, "n", "ids", "n_big")


@query("convert_parquet_jsonl", "select * from orders")
def _(spark, folder):
    path = scratch_path(spark, "convert") + ".jsonl"
    convert(spark, f"{folder}/orders.parquet", path)
    return read_any(spark, path, schema=table(spark, folder, "orders").schema)


@query("csv_to_json", """
    select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority || ', "x"' as note, o_orderstatus from orders""")
def _(spark, folder):
    source, target = scratch_path(spark, "cells") + ".csv", scratch_path(spark, "cells") + ".json"
    notes = table(spark, folder, "orders").select(
        "o_orderkey", F.concat("o_orderpriority", F.lit(', "x"')).alias("note"),
        F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")).alias("o_orderstatus"))
    write_any(notes, source, sep=";")
    csv_to_json(spark, source, target, delimiter=";")
    return read_any(spark, target).select("o_orderkey", "note", "o_orderstatus")


@query("roundtrip_csv_documents", "select doc_id, text, lang, source, n_chars from documents")
def _(spark, folder):
    path = scratch_path(spark, "prose") + ".csv"
    write_any(table(spark, folder, "documents"), path)
    return read_any(spark, path)


@query("csv_to_json_documents", """
    select cast(doc_id as varchar) as doc_id, text || chr(10) || '"quoted", ' || source as text, cast(n_chars as varchar) as n_chars from documents""")
def _(spark, folder):
    source, target = scratch_path(spark, "prose") + ".csv", scratch_path(spark, "prose") + ".jsonl"
    quoted = F.concat("text", F.lit('\n"quoted", '), "source").alias("text")
    write_any(table(spark, folder, "documents").select("doc_id", quoted, "n_chars"), source)
    csv_to_json(spark, source, target)
    return read_any(spark, target).select("doc_id", "text", "n_chars")


@query("wide_integers", "select o_orderkey + 9223372036850000000 as id, '9' || (o_orderkey + 9223372036850000000)::varchar as wide from orders")
def _(spark, folder):
    path = scratch_path(spark, "wide") + ".csv"
    # in decimals: keys of 4,775,808 and more leave bigint, and their ids are read back as text
    ids = (F.col("o_orderkey").cast("decimal(19,0)") + F.lit(9223372036850000000).cast("decimal(19,0)")).alias("id")
    write_any(table(spark, folder, "orders").select(ids, F.concat(F.lit("9"), ids.cast("string")).alias("wide")), path)
    return read_any(spark, path)


@query("json_to_csv", """
    select cast(o_orderkey as varchar) as o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '') as status,
           '{"by":' || o_custkey || ',"level":"' || o_orderpriority || '"}' as who from orders""")
def _(spark, folder):
    source, target = scratch_path(spark, "objects") + ".jsonl", scratch_path(spark, "objects") + ".csv"
    nested = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.struct(F.col("o_custkey").alias("by"), F.col("o_orderpriority").alias("level")).alias("who"))
    write_any(nested, source)
    json_to_csv(spark, source, target, delimiter="\\t")
    cells = read_any(spark, target, schema="o_orderkey string, status string, who string", sep="\t")
    return cells.select("o_orderkey", F.coalesce("status", F.lit("")).alias("status"), "who")


@query("csv_sniff", "select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_acctbal as varchar) as s_acctbal from supplier")
def _(spark, folder):
    path = scratch_path(spark, "sniff") + ".csv"
    table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(path, header=True, sep="|")
    return read_sniffed(spark, path)


@query("xml_roundtrip", """
    select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_acctbal as varchar) as c_acctbal,
           nullif(c_mktsegment, 'BUILDING') as "segment_of_1" from customer""")
def _(spark, folder):
    source, xml, target = (scratch_path(spark, "xml") + end for end in (".jsonl", "-files", ".jsonl"))
    odd = customers(spark, folder).select("c_custkey", "c_name", "c_acctbal", F.col("segment").alias("segment of 1"))
    write_any(odd, source)
    json_to_xml(spark, source, xml, "customers", "customer")
    xml_to_json(spark, xml, target, "customer")
    return read_any(spark, target).select("c_custkey", "c_name", "c_acctbal", "segment_of_1")


@query("xml_attributes", """
    select cast(o_orderkey as varchar) as id, o_orderpriority as text, len(['a', o_orderstatus]) as tags from orders""")
def _(spark, folder):
    path = scratch_path(spark, "attributes")
    nested = table(spark, folder, "orders").select(
        F.struct(F.col("o_orderkey").alias("@id"), F.col("o_orderpriority").alias("#text")).alias("head"),
        F.array(F.lit("a"), F.col("o_orderstatus")).alias("tag"))
    nested.write.format("xml").options(rootTag="orders", rowTag="order", attributePrefix="@", valueTag="#text").save(path)
    back = read_xml(spark, path, "order")
    return back.select(F.col("head.`@id`").alias("id"), F.col("head.`#text`").alias("text"), F.size("tag").alias("tags"))


@query("file_inventory", "select o_orderstatus as status, 1 as formats from orders group by 1")
def _(spark, folder):
    path = scratch_path(spark, "inventory")
    partition_by(table(spark, folder, "orders"), ["o_orderstatus"], path)
    files = file_inventory(spark, path, "*.parquet", max_age_hours=24, min_size_mb=0.0, max_size_mb=1e6)
    status = F.regexp_extract("path", "o_orderstatus=([^/]+)/", 1).alias("status")
    kind = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    return files.filter("size_bytes > 0").groupBy(status).agg(F.count_distinct(kind).alias("formats"))


# --- catalog tables ------------------------------------------------------------------

def _fresh(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:12]}"


@query("table_insert", "select * from supplier union all select * from supplier")
def _(spark, folder):
    name = _fresh("supplier_insert")
    write_table(table(spark, folder, "supplier"), name)
    write_table(table(spark, folder, "supplier").select("s_acctbal", "s_nationkey", "s_name", "s_suppkey"), name)
    return spark.table(name)


@query("table_replace", "select c_custkey as id, c_name as name, c_acctbal as amount, null::varchar as note from customer")
def _(spark, folder):
    name = _fresh("replaced")
    orders = table(spark, folder, "orders")
    write_table(orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"),
                              F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("note")), name)
    buyers = table(spark, folder, "customer")
    write_table(buyers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                              F.col("c_acctbal").alias("amount")), name, mode="replace")
    return spark.table(name)


@query("table_drift", """
    select s_suppkey as id, cast(s_nationkey as double) as amount, null as name, null as segment from supplier
    union all select c_custkey, c_acctbal, c_name, null from customer
    union all select c_custkey, c_nationkey, null, c_mktsegment from customer""")
def _(spark, folder):
    name = _fresh("drifting")
    sellers, buyers = table(spark, folder, "supplier"), table(spark, folder, "customer")
    write_table(sellers.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("amount")), name)
    write_table(buyers.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"),
                              F.col("c_name").alias("name")), name, schema_drift=True)
    write_table(buyers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("amount"),
                              F.col("c_mktsegment").alias("segment")), name, schema_drift=True)
    return spark.table(name).select("id", "amount", "name", "segment")


# --- SQL -----------------------------------------------------------------------------

SQL = {
    "sql_query_pricing": """
        select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_price,
               round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_net, round(avg(l_discount), 6) as avg_disc,
               count(*) as n
        from lineitem where l_shipdate <= timestamp '2001-09-02 00:00:00' group by l_returnflag, l_linestatus""",
    "sql_query_top_customers": """
        select c_custkey, c_name, round(sum(o_totalprice), 2) as total from customer join orders on c_custkey = o_custkey
        group by c_custkey, c_name order by sum(o_totalprice) desc, c_custkey limit 20""",
    "sql_query_exists": """
        select o_orderpriority, count(*) as n from orders
        where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45) group by o_orderpriority""",
    "sql_query_rank": """
        select o_custkey, o_orderkey, o_totalprice, place from (
            select o_custkey, o_orderkey, o_totalprice,
                   row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) r
        where place <= 3""",
    "sql_query_rollup": """
        select n_name, c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance
        from customer join nation on c_nationkey = n_nationkey group by rollup (n_name, c_mktsegment)""",
}

for _name, _sql in SQL.items():
    @query(_name, _sql)
    def _(spark, folder, sql=_sql):
        names = [t for t in ("customer", "orders", "lineitem", "nation") if t in sql]
        return sql_query(spark, sql, {n: table(spark, folder, n) for n in names})


# --- generated rows ------------------------------------------------------------------

@query("generate_ids", "select o_orderkey, 10 + 5 * (row_number() over (order by o_orderkey) - 1) as id from orders")
def _(spark, folder):
    placed = with_position(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], "place")
    return add_generated(placed, F.col("place") - 1, [{"name": "id", "type": "id", "start": 10, "step": 5}]).drop("place")


# Each generated column with the shape its texts must have.
SHAPES = {
    "n_integer": ({"type": "integer", "min": 5, "max": 9}, "^[5-9]$"),
    "n_float": ({"type": "float", "min": 1, "max": 2, "decimals": 3}, r"^(1\.\d{1,3}|2\.0)$"),
    "n_boolean": ({"type": "boolean"}, "^(true|false)$"),
    "n_date": ({"type": "date", "min": "2023-01-01", "max": "2023-12-31", "format": "%d/%m/%Y"}, r"^\d\d/\d\d/2023$"),
    "n_datetime": ({"type": "datetime", "min": "2023-01-01T00:00:00", "max": "2023-01-31T23:59:59"},
                   r"^2023-01-\d\d( \d\d:\d\d:\d\d)?"),
    "n_time": ({"type": "time", "minHour": 8, "maxHour": 9}, r"^0[89]:[0-5]\d:[0-5]\d$"),
    "n_first": ({"type": "prenom"}, r"^\p{Lu}\p{Ll}+$"),
    "n_last": ({"type": "last_name"}, r"^\p{Lu}\p{Ll}+$"),
    "n_full": ({"type": "full_name"}, r"^\p{L}+ \p{L}+$"),
    "n_email": ({"type": "email"}, r"^[a-z]+\d\d@[a-z.]+$"),
    "n_phone": ({"type": "phone", "prefix": "+33"}, r"^\+33 \d{3} \d{4}$"),
    "n_country": ({"type": "country", "format": "code"}, "^[A-Z]{2}$"),
    "n_city": ({"type": "city"}, r"^\p{L}+$"),
    "n_address": ({"type": "address"}, r"^[\p{L} ]+ \d{1,3}, \p{L}+$"),
    "n_postal": ({"type": "postal_code", "country": "CA"}, r"^[A-Z]\d[A-Z] \d[A-Z]\d$"),
    "n_text": ({"type": "text", "minWords": 2, "maxWords": 4}, r"^[a-z]+( [a-z]+){1,3}$"),
    "n_pattern": ({"type": "pattern", "pattern": "##-Aa-X?x/"}, r"^\d\d-[A-Z][a-z]-[0-9A-Z][A-Za-z][0-9a-z]/$"),
    "n_other": ({"type": "no such type"}, r"^[a-z]+( [a-z]+)+$"),
}


@query("generate_shapes", "select c_custkey, " + ", ".join(f"true as {n}" for n in SHAPES) + " from customer")
def _(spark, folder):
    spec = [{"name": name, **rule} for name, (rule, _) in SHAPES.items()]
    made = add_generated(table(spark, folder, "customer").select("c_custkey"), F.col("c_custkey"), spec, seed=7)
    return made.select("c_custkey", *[F.col(name).cast("string").rlike(shape).alias(name) for name, (_, shape) in SHAPES.items()])


@query("generate_beside", "select c_custkey, 8 as width, true as fits from customer")
def _(spark, folder):
    buyers = table(spark, folder, "customer").select("c_custkey")
    made = add_generated(buyers, F.col("c_custkey"), [{"name": "code", "type": "pattern", "pattern": "AAAA####"}])
    return made.select("c_custkey", F.length("code").alias("width"), F.col("code").rlike("^[A-Z]{4}[0-9]{4}$").alias("fits"))
