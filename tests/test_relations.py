import math
import re
from collections import Counter

import pytest
from conftest import plan_of, tuples
from pyspark.sql import functions as F

from tablewright import (anti_join, count_by, deduplicate, groupby, head, histogram, histogram_quantiles, join, lookup, metric,
                         partition_by, profile, require_schema, schema_check, sort, top_groups, upsert, with_position)
from tablewright import merge_sketches, sketched_counts, unique_sketch
from tablewright.operators import joins, ordering
from tablewright.operators.text_columns import map_text


def brute_join(left, right, how):
    out, hit = [], set()
    for k, a in left:
        matches = [(i, b) for i, (rk, b) in enumerate(right) if k is not None and rk == k]
        hit.update(i for i, _ in matches)
        out += [(k, a, b) for _, b in matches]
        if not matches and how != "inner":
            out.append((k, a, None))
    if how == "outer":
        out += [(rk, None, b) for i, (rk, b) in enumerate(right) if i not in hit]
    return sorted(out, key=str)


LEFT = [(7, f"l{i}") for i in range(40)] + [(i, f"m{i}") for i in range(5)] + [(None, "n"), (None, "o"), (99, "p")]
RIGHT = [(7, "r1"), (7, "r2"), (3, "r3"), (None, "rn"), (55, "r5"), (4, "r4"), (4, "r4")]


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
@pytest.mark.parametrize("swap", [False, True])
def test_join_with_hot_and_null_keys(spark, shuffled_joins, how, swap):
    left, right = (RIGHT, LEFT) if swap else (LEFT, RIGHT)
    a, b = spark.createDataFrame(left, "k int, v string"), spark.createDataFrame(right, "rk int, v string")
    out = join(a, b, "k", "rk", how)
    assert out.columns == ["k", "v", "v_right"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_join(left, right, how)


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_join_small_side(spark, how):
    a, b = spark.createDataFrame(LEFT, "k int, v string"), spark.createDataFrame(RIGHT, "k int, w string")
    out = join(a, b, "k", how=how)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_join(LEFT, RIGHT, how)
    assert join(a, b, "k", how="sideways").count() == len(brute_join(LEFT, RIGHT, "inner"))


@pytest.mark.parametrize("how", ["left", "outer"])
def test_hot_keys_of_either_side_are_dealt_out(spark, shuffled_joins, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_ROWS", 7)
    a = [(k, f"v{i}") for i, k in enumerate([1] * 60 + [2] * 3 + [None] * 20 + [4] * 30 + [5])]
    b = [(k, f"w{i}") for i, k in enumerate([1] * 40 + [3] * 50 + [None] * 25 + [4] + [5] * 30)]
    out = join(spark.createDataFrame(a, "k int, v string").repartition(3), spark.createDataFrame(b, "k int, w string").repartition(3), "k", how=how)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_join(a, b, how)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = out.filter("k = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1 and "Cartesian" not in plan_of(out)


def test_joins_read_each_input_once(spark, shuffled_joins, tmp_path):
    for name, rows, schema in (("a", LEFT, "k int, v string"), ("b", RIGHT, "k int, w string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    calls = spark.sparkContext.accumulator(0)

    def model():
        def answer(text):
            calls.add(1)
            return text

        return answer

    answered = map_text(a, "v", model, "said")
    assert len(join(answered, b, "k", how="left").collect()) == len(brute_join(LEFT, RIGHT, "left"))
    assert calls.value == sum(1 for r in LEFT if r[1])
    for how in ("left", "outer"):
        scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of(join(a, b, "k", how=how)))
        assert sum("v#" in s for s in scans) == sum("w#" in s for s in scans) == 1
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of(upsert(a, b.withColumnRenamed("w", "v"), ["k"])))
    assert sum("v#" in s for s in scans) == 1


def test_lookup_golden(spark):
    staff = spark.createDataFrame([(1, "Alice", "FR"), (2, "Bob", "US"), (1, "Alice", "FR"), (3, "Charlie", "FR"),
                                   (4, "David", "DE"), (5, "Eve", "XX")], "id int, name string, country_code string")
    words = spark.createDataFrame([("FR", "France", 1), ("US", "Etats-Unis", 2), ("DE", "Allemagne", 3)],
                                  "code string, country_name string, extra int")
    out = lookup(staff, words, "country_code", "code", "country_name")
    assert out.columns == ["id", "name", "country_code", "country_name"]
    assert {r["name"]: r["country_name"] for r in out.collect()} == {
        "Alice": "France", "Bob": "Etats-Unis", "Charlie": "France", "David": "Allemagne", "Eve": None}
    assert deduplicate(out, ["id"]).count() == 5
    assert lookup(staff, words.union(words), "country_code", "code", "country_name").count() == 11
    assert [r[-1] for r in lookup(staff.limit(1), words, "country_code", "code", "code").collect()] == ["FR"]


def test_groupby(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5), (None, None), (None, None)], "cat string, val int")
    assert tuples(groupby(df, ["cat"], "val", "sum")) == [("a", 30), ("b", 5), (None, 0)]
    assert tuples(groupby(df, ["cat"], "val", "count")) == [("a", 2), ("b", 1), (None, 0)]
    assert groupby(df, ["cat"], "val", "avg").columns == ["cat", "val_avg"]
    with pytest.raises(ValueError):
        groupby(df, ["cat"], "val", "median")


def test_metric(spark):
    df = spark.createDataFrame([("ab",), ("b",), (None,), ("b",)], "s string")
    value = lambda *a, **k: metric(df, "s", *a, **k).first()["value"]
    assert value("null_count") == 1 and value("n_unique") == 3 and value("count") == 3
    assert value("match_regex", pattern="a") == 1 and value("non_match_regex", pattern="a") == 2
    assert value("count", limit_rows=2, order_by=["s"]) == 1
    with pytest.raises(ValueError):
        value("match_regex")
    with pytest.raises(ValueError):
        metric(df, "t", "sum")
    assert metric(df.limit(0), "s", "n_unique").first()["value"] == 0


def test_histogram_and_quantiles(spark):
    values = [0.005, 0.3, 0.4, 0.9, 2.0, 70.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "g string, v double")
    rows = {(r["g"], r["le"]): r["bucket_count"] for r in histogram(df, "v", ["g"]).collect()}
    assert rows["a", "0.01"] == 1 and rows["a", "0.5"] == 3 and rows["a", "60.0"] == 5 and rows["a", "+Inf"] == 6
    assert rows["b", "+Inf"] == 0
    q = {r["g"]: r for r in histogram_quantiles(df, "v", [0.5, 0.99], ["g"]).collect()}
    assert math.isclose(q["a"]["p50"], 0.5) and q["a"]["p99"] == 60.0 and q["b"]["p50"] is None
    assert count_by(df, ["g"]).count() == 2


def test_profile(spark):
    df = spark.createDataFrame([("1", "x"), ("2.5", ""), ("abc", None), ("2.5", "y"), (" ", "x")], "a string, b string")
    out = {r["column"]: r for r in profile(df, samples=3).collect()}
    a, b = out["a"], out["b"]
    assert (a["type"], a["total_rows"], a["nulls"], a["null_pct"], a["uniques"]) == ("numeric", 5, 1, 20.0, 4)
    assert (a["min"], a["max"], a["mean"], a["std"]) == (1.0, 2.5, 2.0, 0.71)
    assert a["samples"] == [" ", "1", "2.5"]
    assert (b["type"], b["nulls"], b["null_pct"], b["uniques"], b["mean"]) == ("text", 2, 40.0, 3, None)


def test_schema_check(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    report = schema_check(df, "a, c")
    assert report == {"ok": False, "actual": ["a", "b"], "expected": ["a", "c"], "missing": ["c"], "extra": ["b"]}
    assert schema_check(df, '["a"]')["ok"] and require_schema(df, ["b"]) is df
    with pytest.raises(ValueError):
        require_schema(df, "z")


def test_sort_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (2, "a")], "v int, t string")
    assert [tuple(r) for r in sort(df, "v").collect()] == [(1, "a"), (2, "a"), (2, "b"), (None, "n")]
    assert [r["v"] for r in sort(df, "v", descending=True).collect()] == [2, 2, 1, None]


@pytest.mark.parametrize("source", ["plain", "shuffled"])
def test_positions_number_every_row_once(spark, source):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.lit("same").alias("t"))
    if source == "shuffled":
        df = df.repartition(5, "g")
    out = with_position(df, ["g"]).collect()
    assert sorted(r["position"] for r in out) == list(range(1, 1001))
    assert [r["g"] for r in sorted(out, key=lambda r: r["position"])] == sorted(r["g"] for r in out)


def test_head_short_and_long(spark):
    df = spark.range(100).select((100 - F.col("id")).alias("v"))
    short = sorted(r["v"] for r in head(df, 7, ["v"]).collect())
    assert short == list(range(1, 8)) and head(df, 1_000_000, ["v"]).count() == 100
    assert "TakeOrdered" not in plan_of(head(df, 700, ["v"]))
    assert tuples(top_groups(df.select((F.col("v") % 3).alias("m")), ["m"], 1)) == [(1, 34)]


@pytest.mark.parametrize("n", [0, 1, 64, 65, 100, 5000, 59_000, 200_000])
def test_head_takes_the_first_rows(spark, monkeypatch, n):
    monkeypatch.setattr(ordering, "SAMPLED", 16)
    rows = [(None if i % 11 == 0 else (i * 7919) % 1000, i % 5, f"t{i % 300}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "v int, w int, t string").repartition(6)
    first = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))[:n]
    assert sorted(map(str, map(tuple, head(df, n, ["v"]).collect()))) == sorted(map(str, first))
    last = sorted(rows, key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[1]))[:n]
    assert sorted(map(str, map(tuple, head(df, n, ["t"]).collect()))) == sorted(map(str, last))


def test_head_moves_only_what_it_must(spark, monkeypatch):
    """A third of the rows share the first value; the bound then goes by the other columns."""
    monkeypatch.setattr(ordering, "SAMPLED", 16)
    df = spark.range(60_000).select((F.greatest(F.col("id"), F.lit(20_000)) - 20_000).alias("v"), "id", F.timestamp_micros(-F.col("id")).alias("at"))
    moved = []
    plain = ordering.with_position
    monkeypatch.setattr(ordering, "with_position", lambda rows, *a: moved.append(rows.count()) or plain(rows, *a))
    assert sorted(r["id"] for r in head(df, 1000, ["v"]).collect()) == list(range(1000))
    assert max(moved) < 3000
    assert sorted(r["id"] for r in head(df, 1000, ["at"]).collect()) == list(range(59_000, 60_000))
    assert max(moved) < 3000
    assert sorted(r["id"] for r in head(df, 300, [F.col("id").desc()]).collect()) == list(range(59_700, 60_000))
    assert head(df.select(F.lit(1).alias("one")), 30_000, ["one"]).count() == 30_000


def test_deduplicate(spark):
    rows = [(1, "a", 1), (2, "b", 2), (1, "c", 3), (3, "d", 4), (None, "e", 5), (None, "f", 6)]
    df = spark.createDataFrame(rows, "id int, val string, n int")
    assert tuples(deduplicate(df, ["id"], order_by=["n"])) == [(1, "a", 1), (2, "b", 2), (3, "d", 4), (None, "e", 5)]
    assert tuples(deduplicate(df, ["id"], keep="last", order_by=["n"])) == [(1, "c", 3), (2, "b", 2), (3, "d", 4), (None, "f", 6)]
    assert deduplicate(df.union(df)).count() == 6
    assert deduplicate(df, ["id", "val", "n"]).count() == 6
    with pytest.raises(ValueError):
        deduplicate(df, ["id"], keep="any")


def test_a_hot_key_is_thinned_before_the_shuffle(spark):
    plan = plan_of(deduplicate(spark.range(10).selectExpr("id % 3 as k", "id"), ["k"], order_by=["id"]))
    shuffle = plan.index("Exchange hashpartitioning")
    assert "Partial" in plan[shuffle:] and "WindowGroupLimit" in plan[shuffle:]


@pytest.fixture
def touchy_skew(spark, shuffled_joins):
    """Partitions count as skewed at test size."""
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def hot(spark, tmp_path, name, share, n=40_000):
    """A table of n rows in which one key holds the given share."""
    path = str(tmp_path / name)
    key = F.when(F.col("id") % 100 < int(share * 100), 7).otherwise(F.col("id") % 5000)
    (spark.range(0, n, 1, 8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias(f"v_{name}"))
     .write.parquet(path))
    return spark.read.parquet(path)


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_keys_are_split_on_either_side(spark, touchy_skew, tmp_path, monkeypatch):
    big = hot(spark, tmp_path, "big", 0.34)
    few = spark.range(0, 4000, 1, 4).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("w"))
    few.write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    expected = Counter(min(r["k"], 4000) for r in big.collect())
    rows, plan = executed(join(big, few, "k", how="left"))
    assert len(rows) == 40_000 and sum(r["w"] is None for r in rows) == expected[4000]
    assert plan.count("SortMergeJoin(skew=true)") >= 1
    monkeypatch.setattr(joins, "HOT_ROWS", 2000)
    joined = join(few, big, "k", how="outer")
    assert len(joined.collect()) == 40_000 + sum(k not in expected for k in range(4000))
    sizes = [r["count"] for r in joined.filter("k = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == expected[7] and max(sizes) < 0.5 * expected[7]


def test_hot_target_keys_are_split_in_change_capture(spark, touchy_skew, tmp_path, monkeypatch):
    target = hot(spark, tmp_path, "t", 0.34)
    source = spark.range(0, 3000, 1, 4).select(F.col("id").alias("k"), F.lit("new").alias("v_t"))
    source.write.parquet(str(tmp_path / "s"))
    source = spark.read.parquet(str(tmp_path / "s"))
    rows, plan = executed(anti_join(target, source.filter("k <> 7"), ["k"]))
    assert "SortMergeJoin(skew=true)" in plan and sum(r["k"] == 7 for r in rows) >= 13_600
    monkeypatch.setattr(joins, "HOT_ROWS", 2000)
    changed = upsert(target, source, ["k"])
    rows = changed.collect()
    sizes = [r["count"] for r in changed.filter("k = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)
    assert sum(r["v_t"] == "new" for r in rows) == target.filter("k < 3000").count() + \
        source.join(target, "k", "left_anti").count()


def test_a_hot_value_is_written_as_several_files(spark, touchy_skew, tmp_path):
    df = hot(spark, tmp_path, "w", 0.5).withColumn("part", F.when(F.col("k") == 7, 1).otherwise(F.col("k") % 3 + 2))
    partition_by(df, ["part"], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40_000
    files = back.select("part", F.input_file_name().alias("f")).distinct().groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in files}[1] > 3


def test_sketches_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 9000).alias("v"), (F.col("id") % 7).alias("day"), F.lit(None).cast("double").alias("x"))
    near = metric(df, "v", "approx_n_unique").first()[0]
    assert abs(near - 9000) < 0.02 * 9000
    parts = unique_sketch(df, "v", ["day"])
    assert parts.count() == 7
    whole = sketched_counts(merge_sketches(parts)).first()[0]
    assert abs(whole - near) < 0.005 * 9000
    assert metric(df, "x", "approx_n_unique").first()[0] == metric(df, "x", "n_unique").first()[0] == 1


def test_profile_moves_no_texts_but_candidates(spark):
    df = spark.range(20_000).select(F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("t"), F.lit("one").alias("c"))
    rows = {r["column"]: r for r in profile(df).collect()}
    assert rows["t"]["uniques"] == 20_000 and rows["t"]["samples"] == [f"text {i:06d}" for i in range(5)]
    assert rows["c"]["uniques"] == 1 and rows["c"]["samples"] == ["one"]


def test_plain_joins_without_hot_keys(spark, shuffled_joins):
    left, right = spark.range(100).toDF("k"), spark.range(0, 200, 2).select(F.col("id").alias("j"), F.col("id").alias("w"))
    for how in ("left", "outer"):
        plan = plan_of(join(left, right, "k", "j", how))
        assert "Generate" not in plan and "BroadcastHashJoin" not in plan
    assert join(left, right, "k", "j", "outer").count() == 150
