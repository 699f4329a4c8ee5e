import pytest
from conftest import plan_of, tuples
from pyspark.errors import PySparkException

from tablewright import (delta, explode_column, merge, partition_by, pivot, read_partitioned, scd2, schema_drift_upsert, split_by, sync,
                         sync_counts, union_with_drift, unpivot, upsert)


def test_delta_golden(spark):
    source = spark.createDataFrame([(1, "Jean", 21, "2026-06-07"), (2, "Marie", 25, "2026-06-01"),
                                    (4, "Sophie", 28, "2026-06-07")], "id int, name string, age int, day string")
    target = spark.createDataFrame([(1, "Jean", 20, "2026-06-01"), (2, "Marie", 25, "2026-06-01"),
                                    (3, "Pierre", 30, "2026-06-01")], source.schema)
    d = delta(source, target, ["id"])
    assert sorted(r["id"] for r in d.upserts.collect()) == [1, 2, 4]
    assert [r["id"] for r in d.deletes.collect()] == [3]
    assert {r["id"]: r["age"] for r in d.sync.collect()} == {1: 21, 2: 25, 4: 28, 3: 30}


def test_upsert_golden(spark):
    target = spark.createDataFrame([(1, "Jean", "User"), (2, "Marie", "Admin")], "id int, name string, role string")
    source = spark.createDataFrame([(1, "Jean", "SuperUser"), (3, "Sophie", "Guest")], target.schema)
    assert tuples(upsert(target, source, ["id"])) == [(1, "Jean", "SuperUser"), (2, "Marie", "Admin"), (3, "Sophie", "Guest")]


def test_upsert_keeps_columns_rows_and_null_keys(spark, shuffled_joins):
    target = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "c", 12), (None, "d", 13)], "id int, name string, n int")
    source = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 3), (None, "w", 4), (5, None, 5)],
                                   "id int, name string, at int")
    out = upsert(target, source.select("id", "name", "at"), ["id"], order_by=["at"], schema_drift=True).drop("at")
    assert tuples(out) == [(1, "y", 10), (1, "y", 11), (2, "c", 12), (5, None, None), (None, "d", 13), (None, "w", None),
                           (None, "z", None)]
    keys_only = upsert(target, source.select("id").distinct(), ["id"])
    assert keys_only.count() == 6 and (2, "c", 12) in tuples(keys_only)
    with pytest.raises(ValueError):
        upsert(target, source, ["id"])


def test_upsert_sets_null_from_the_source(spark):
    target = spark.createDataFrame([(1, "a")], "id int, name string")
    source = spark.createDataFrame([(1, None)], "id int, name string")
    assert tuples(upsert(target, source, ["id"])) == [(1, None)]


def test_sync(spark):
    target = spark.createDataFrame([(1, 1, "a", "keep"), (1, 2, "b", "keep2"), (3, 3, "c", "gone")],
                                   "k int, l int, v string, extra string")
    source = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "k int, l int, v string")
    assert tuples(sync(target, source, ["k", "l"])) == [(1, 1, "x", "keep"), (2, 2, "y", None)]
    assert sync_counts(target, source, ["k", "l"]).first().asDict() == {"inserted": 1, "updated": 1, "deleted": 2}
    assert sync(target, source.limit(0), ["k"]).count() == 3
    assert sync_counts(target, source.limit(0), ["k"]).first().asDict() == {"inserted": 0, "updated": 0, "deleted": 0}


HISTORY = "id int, name string, city string, valid_from string, valid_to string, is_current {}"


@pytest.mark.parametrize("kind, on, off", [("boolean", True, False), ("string", "true", "0"), ("int", 1, 0)])
def test_scd2(spark, kind, on, off):
    target = spark.createDataFrame([
        (1, "same", "P", "2020", None, on), (2, "old", "P", "2020", None, on), (3, "removed", "P", "2020", None, None),
        (4, "past", "P", "2019", "2020", off), (None, "null key", "P", "2020", None, on)], HISTORY.format(kind))
    source = spark.createDataFrame([(1, "same", "P"), (2, "new", "P"), (4, "back", "P"), (5, None, "L"), (None, "null key", "Q")],
                                   "id int, name string, city string")
    out = scd2(source, target, ["id"], "2024")
    assert out.columns == target.columns and out.schema["is_current"].dataType == target.schema["is_current"].dataType
    mark = {"boolean": (True, False), "string": ("true", "false"), "int": (1, 0)}[kind]
    assert tuples(out) == tuples(spark.createDataFrame([
        (1, "same", "P", "2020", None, on), (2, "old", "P", "2020", "2024", mark[1]), (2, "new", "P", "2024", None, mark[0]),
        (3, "removed", "P", "2020", "2024", mark[1]), (4, "past", "P", "2019", "2020", off),
        (4, "back", "P", "2024", None, mark[0]), (5, None, "L", "2024", None, mark[0]),
        (None, "null key", "P", "2020", "2024", mark[1]), (None, "null key", "Q", "2024", None, mark[0])], target.schema))


def test_scd2_compare_columns_first_load_and_errors(spark):
    source = spark.createDataFrame([(1, "a", "x")], "id int, name string, note string")
    first = scd2(source, None, ["id"], "2023", valid_from_col="f", valid_to_col="t", is_current_col="c")
    assert tuples(first) == [(1, "a", "x", "2023", None, True)]
    renoted = spark.createDataFrame([(1, "a", "y")], source.schema)
    names = {"valid_from_col": "f", "valid_to_col": "t", "is_current_col": "c"}
    assert scd2(renoted, first, ["id"], "2024", compare_columns=["name"], **names).count() == 1
    assert scd2(renoted, first, ["id"], "2024", **names).count() == 2
    again = scd2(source, scd2(renoted, first, ["id"], "2024", **names), ["id"], "2025", **names)
    assert again.filter("c").count() == 1 and again.count() == 3
    for bad in (lambda: scd2(source.union(source), first, ["id"], "2024", **names),
                lambda: scd2(source, first.union(first), ["id"], "2024", **names)):
        with pytest.raises(PySparkException, match="key not unique"):
            bad().collect()
    assert "Join" not in plan_of(again)


def test_drift(spark):
    a = spark.createDataFrame([(1, True, 5)], "id int, flag boolean, n int")
    b = spark.createDataFrame([(2.5, "x", "new")], "id double, n string, extra string")
    out = union_with_drift(a, b)
    assert dict(out.dtypes) == {"id": "double", "flag": "boolean", "n": "string", "extra": "string"}
    assert tuples(out) == [(1.0, True, "5", None), (2.5, None, "x", "new")]
    merged = schema_drift_upsert(a, b.select("id", "extra"), ["id"])
    assert tuples(merged) == [(1.0, True, 5, None), (2.5, None, None, "new")]


def test_merge(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    assert tuples(merge([a, a.select("b", "a"), a])) == [(1, "x")] * 3
    with pytest.raises(ValueError):
        merge([])


def test_pivot_unpivot_golden(spark):
    df = spark.createDataFrame([(2025, "Jan", 100), (2025, "Feb", 120), (2026, "Jan", 150), (2026, "Feb", 180)],
                               "year int, month string, revenue int")
    wide = pivot(df, ["year"], "month", "revenue", "sum")
    assert wide.columns == ["year", "Feb", "Jan"] and tuples(wide) == [(2025, 120, 100), (2026, 180, 150)]
    back = unpivot(wide, ["year"], variable_name="month", value_name="revenue")
    assert tuples(back) == tuples(df)
    sales = spark.createDataFrame([("A", "North", 10), ("A", "South", 20), ("B", "North", 5)], "product string, region string, qty int")
    assert tuples(pivot(sales, ["product"], "region", "qty", "sum")) == [("A", 10, 20), ("B", 5, None)]


def test_pivot_order_and_nulls(spark):
    df = spark.createDataFrame([("a", "x", 1, 2), ("a", "x", 2, 1), ("b", "x", 3, None), ("b", None, 4, 9)],
                               "g string, c string, at int, v int")
    assert tuples(pivot(df, ["g"], "c", "v", "first", order_by=["at"]).select("g", "x")) == [("a", 2), ("b", None)]
    assert tuples(pivot(df, ["g"], "c", "v", "last", order_by=["at"]).select("g", "x")) == [("a", 1), ("b", None)]
    assert tuples(pivot(df, ["g"], "c", "v", "sum").select("g", "x")) == [("a", 3), ("b", 0)]


def test_unpivot_types(spark):
    df = spark.createDataFrame([(1, 2, 2.5, True, "t")], "id int, i int, d double, b boolean, s string")
    assert dict(unpivot(df, ["id"], ["i", "d"]).dtypes)["value"] == "double"
    assert tuples(unpivot(df, ["id"])) == [(1, "b", "true"), (1, "d", "2.5"), (1, "i", "2"), (1, "s", "t")]


def test_explode_golden(spark):
    df = spark.createDataFrame([(1, "rust,polars,etl"), (2, "n8n,switch"), (3, None), (4, "")], "id int, tags string")
    assert [r["tags"] for r in explode_column(df, "tags", ",").orderBy("id").collect()] == \
        ["rust", "polars", "etl", "n8n", "switch", None, ""]
    lists = spark.createDataFrame([(1, '["a", "b"]')], "id int, t string")
    assert [r["t"] for r in explode_column(lists, "t").collect()] == ["a", " b"]
    arrays = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, t array<string>")
    assert explode_column(arrays, "t").count() == 3
    assert [r["t"] for r in explode_column(spark.createDataFrame([("a.b|c",)], "t string"), "t", "|").collect()] == ["a.b", "c"]


def test_split_and_partition(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 10), ("b", 2, 11), ("a", 3, 10), (None, 4, 10)], "cat string, val int, n int")
    split_by(df, "cat", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "by_cat=a")).count() == 2
    partition_by(df, ["cat", "n"], str(tmp_path / "p"), "csv", header=True)
    back = read_partitioned(spark, str(tmp_path / "p"), "csv", header=True)
    assert back.columns == df.columns and back.count() == 4 and back.filter("cat is null").count() == 1
    assert back.filter("cat = 'a' and n = 10").count() == 2


def test_partitions_keep_values_and_types(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("1", 2), ("", 3), (None, 4), ("a=b/c", 5)], "code string, v long")
    partition_by(df, ["code"], str(tmp_path / "p"))
    back = read_partitioned(spark, str(tmp_path / "p"))
    assert back.schema == df.schema and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
