"""SQL over named tables, catalog tables, and tables behind JDBC."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.drift import conform, union_with_drift, widened_schema
from tablewright.sources.scratch import file_system, remove


def sql_query(spark: SparkSession, query: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """A SELECT over frames known by name. Views of the session with these names stay as they are."""
    before = {name: spark.table(name) for name in tables if any(t.isTemporary and t.name == name for t in spark.catalog.listTables())}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query)  # resolved here and now, so the views may go
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


# Properties that the catalog sets by itself.
OWN_PROPERTIES = ("transient_lastDdlTime", "numFiles", "totalSize", "numRows", "rawDataSize")


def _create(df: DataFrame, table: str, path: str | None, partitions: Sequence[str] = ()) -> None:
    """A managed table in the warehouse, or one whose files are at ``path``."""
    writer = df.write.format("parquet").partitionBy(*partitions)
    (writer.option("path", path) if path else writer).saveAsTable(table)


# A table that is about to take another's place, or has just taken it, carries this property.
EXCHANGE = "tablewright.exchange"


def _wide(table: str) -> str:
    """The name under which a table waits to take the place of ``table``."""
    return f"{table[:-1]}__wide`" if table.endswith("`") else f"{table}__wide"


def _about(spark: SparkSession, table: str) -> dict[str, str]:
    return {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").select("col_name", "data_type").collect()}


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def settle(spark: SparkSession, table: str) -> None:
    """End an exchange that was broken off. The waiting table is whole once the old one is gone,
    and then takes its place; while the old one is there, the waiting one goes."""
    wide = _wide(table)
    if spark.catalog.tableExists(wide):
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {wide}")
        else:
            spark.sql(f"ALTER TABLE {wide} RENAME TO {table}")
    if spark.catalog.tableExists(table) and EXCHANGE in _properties(spark, table):
        if any(c.isPartition for c in spark.catalog.listColumns(table)):
            spark.sql(f"MSCK REPAIR TABLE {table}")
        spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES ('{EXCHANGE}')")
        spark.catalog.refreshTable(table)


def _rewrite(rows: DataFrame, table: str) -> None:
    """Put rows of another shape in a table's place, with its partition columns, its properties
    and, for a table with its own path, a path beside that.

    All rows are written first, as a table of another name. Until that is whole the old table
    stays; then the old one goes and the new one takes its name. A failure before leaves the old
    table, one after is made good by :func:`settle`, at once or by the next write.
    """
    spark, wide = rows.sparkSession, _wide(table)
    partitions = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    about = _about(spark, table)
    properties = {k: v for k, v in _properties(spark, table).items() if k not in OWN_PROPERTIES} | {EXCHANGE: "open"}
    outside = about.get("Type", "").upper() == "EXTERNAL"
    written = f"{about['Location'].rstrip('/')}-{uuid.uuid4().hex[:8]}"

    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    parts = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in partitions)})" if partitions else ""
    listed = ", ".join(f"{text(k)} = {text(v)}" for k, v in properties.items())
    try:
        rows.write.partitionBy(*partitions).parquet(written)
        spark.sql(f"CREATE TABLE {wide} ({columns}) USING parquet{parts}{f' LOCATION {text(written)}' if outside else ''} TBLPROPERTIES ({listed})")
        if not outside:
            place = _about(spark, wide)["Location"]
            remove(spark, place)
            system, target = file_system(spark, place)
            system.rename(file_system(spark, written)[1], target)
        spark.sql(f"DROP TABLE {table}")
    except Exception:
        if spark.catalog.tableExists(table):
            settle(spark, table)
            remove(spark, written)
            raise
    try:
        settle(spark, table)
    except Exception:
        settle(spark, table)  # the rows are safe; an error that comes again is the caller's, and the next write settles it


def write_table(df: DataFrame, table: str, mode: str = "insert", schema_drift: bool = False,
                path: str | None = None) -> None:
    """Write to a catalog table, made with the frame's types if it does not exist: in the
    warehouse, or with its files at ``path``.

    ``insert`` or ``append`` adds the rows and ``replace`` puts them in place of all others;
    both keep the table's columns and types. With ``schema_drift`` new columns are added
    and types widened first: new columns in place, wider types by writing the table anew
    beside the old one, which is exchanged for it once that is done.
    """
    if mode not in ("insert", "append", "replace"):
        raise ValueError("mode is 'insert', 'append' or 'replace'")
    spark = df.sparkSession
    settle(spark, table)
    if not spark.catalog.tableExists(table):
        _create(df, table, path)
        return
    current = spark.table(table)
    schema = current.schema
    if schema_drift:
        wide = widened_schema(schema, df.schema)
        if [f.dataType for f in wide.fields[:len(schema)]] != [f.dataType for f in schema.fields]:
            rows = conform(df, wide) if mode == "replace" else union_with_drift(current, df)
            _rewrite(rows, table)
            return
        added = [f for f in wide.fields if f.name not in schema.names]
        if added:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
        schema = wide
    else:
        unknown = [c for c in df.columns if c not in schema.names]
        if unknown:
            raise ValueError(f"columns not in the table: {unknown}")
    conform(df, schema).write.insertInto(table, overwrite=mode == "replace")


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, lower: int | None = None,
              upper: int | None = None, partitions: int | None = None, **properties: str) -> DataFrame:
    """Rows of a SELECT in an external database. Name a whole-number ``column`` with its range
    to read in parallel; without one a single connection carries everything."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **properties)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "insert", batch_size: int = 5000,
               connections: int = 8, **properties: str) -> None:
    """Append to a table, or empty it first and keep its columns (``replace``)."""
    writer = df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch_size,
                                             numPartitions=connections, **properties)
    if mode == "replace":
        writer.option("truncate", True).mode("overwrite").save()
    else:
        writer.mode("append").save()
