import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright import chunk_cumulative
from tablewright.operators import chunks
from tablewright.operators.chunks import Swing, apply_steps, fold, steps_of, swing_of, then
from tablewright.sources.scratch import with_place


def brute(values, threshold, carry=0.0):
    parts, part, total = [], 1, carry
    for v in values:
        total += v
        parts.append(part)
        if total >= threshold:
            part, total = part + 1, 0.0
    return parts, total, part - 1


numbers = st.lists(st.integers(0, 12), max_size=60)
signed = st.lists(st.integers(-9, 12), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.one_of(numbers, signed), st.integers(1, 40), st.integers(-30, 39))
def test_steps_match_the_loop(values, threshold, carry):
    carry = min(carry, threshold - 1)
    f = steps_of(np.array(values, dtype=np.int64), threshold, floor=-30)
    _, total, cuts = brute(values, threshold, carry)
    assert apply_steps(f, carry) == (total, cuts)


@settings(max_examples=300, deadline=None)
@given(st.one_of(numbers, signed), st.one_of(numbers, signed), st.integers(1, 40), st.integers(-30, 39))
def test_composed_steps_match_the_loop(a, b, threshold, carry):
    carry = min(carry, threshold - 1)
    low = 0 if min([0, carry, *a, *b]) >= 0 else -chunks.LIMIT
    f = then(steps_of(np.array(a, dtype=np.int64), threshold, low), steps_of(np.array(b, dtype=np.int64), threshold, low), low)
    _, total, cuts = brute(a + b, threshold, carry)
    assert apply_steps(f, carry) == (total, cuts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5 << 40), max_size=900), st.integers(1 << 39, 700 << 40))
def test_fold_is_the_loop(values, threshold):
    parts = np.empty(len(values), dtype=np.int64)
    expected, total, cuts = brute(values, threshold)
    assert fold(np.array(values, dtype=np.int64), 0, 0, threshold, parts) == (total, cuts)
    assert parts.tolist() == expected


def test_step_functions_stay_as_small_as_a_part():
    f = steps_of(np.ones(100_000, dtype=np.int64), 50, floor=0)
    assert len(f.low) <= 50
    assert len(then(f, f, floor=0).low) <= 50
    rng = np.random.default_rng(1)
    g = steps_of(rng.integers(0, 2000, 100_000), 50_000, floor=0)
    assert len(g.low) <= 150


@settings(max_examples=200, deadline=None)
@given(st.lists(signed, max_size=4))
def test_swings(pieces):
    swing = Swing()
    for piece in pieces:
        swing = swing.and_then(swing_of(np.array(piece, dtype=np.int64)))
    sums = np.concatenate(([0], np.cumsum([v for p in pieces for v in p])))
    assert swing == (sums[-1], sums.max(), sums.min(), min(sums[j] - sums[i] for j in range(len(sums)) for i in range(j + 1)))


def test_open_sums_stay_above_the_deepest_fall():
    rng = np.random.default_rng(4)
    values = rng.integers(-9, 12, 5000)
    floor, total = swing_of(values).fall, 0
    for v in values:
        total += v
        assert total >= floor
        total = 0 if total >= 40 else total
    assert 0 < len(steps_of(values, 40, floor).low) < len(steps_of(values, 40).low) / 2


def check(spark, rows, threshold, keyed, partitions):
    df = spark.createDataFrame(rows, "k string, pos int, v double").repartition(3)
    out = chunk_cumulative(df, "v", threshold, ["pos"], ["k"] if keyed else [], partitions=partitions)
    assert out.columns == ["k", "pos", "v", "part_idx"]
    got = {}
    for r in out.collect():
        got.setdefault(r["k"] if keyed else "", []).append((r["pos"], r["v"], r["part_idx"]))
    wanted = {}
    for k, pos, v in sorted(rows, key=lambda r: (r[1], str(r[0]))):
        wanted.setdefault(k if keyed else "", []).append((pos, v))
    assert set(got) == set(wanted)
    for key, cells in wanted.items():
        parts, _, _ = brute([v or 0.0 for _, v in cells], threshold)
        assert [(p, n) for p, _, n in sorted(got[key], key=lambda c: (c[0], c[2]))] == \
            [(p, n) for (p, _), n in zip(cells, parts)]


def test_small_case(spark):
    check(spark, [("a", i, v) for i, v in enumerate([4.0, 4.0, 4.0, 1.0])], 8, False, 2)


@pytest.mark.parametrize("partitions", [1, 5, 23])
@pytest.mark.parametrize("threshold", [1, 30, 4000, 1e9])
def test_hot_key_over_many_partitions(spark, partitions, threshold):
    rng = np.random.default_rng(5)
    rows = [("hot", i, float(v)) for i, v in enumerate(rng.integers(0, 50, 600))]
    rows += [(f"k{i % 40}", i, float(i % 7)) for i in range(600, 900)] + [(None, 1000 + i, 20.0) for i in range(20)]
    check(spark, rows, threshold, True, partitions)


@pytest.mark.parametrize("threshold", [7, 100, 5000])
def test_whole_table_constant_values(spark, threshold):
    check(spark, [("x", i, 1.0) for i in range(3000)], threshold, False, 40)


def test_negative_and_missing_values(spark):
    rng = np.random.default_rng(8)
    rows = [("x", i, None if i % 11 == 0 else float(v)) for i, v in enumerate(rng.integers(-20, 40, 2000))]
    check(spark, rows, 120, False, 17)


def test_equal_copies_are_spread_and_kept(spark):
    df = spark.range(5000).select(F.lit(1).alias("a"), F.lit(2.0).alias("v"))
    out = chunk_cumulative(df, "v", 20, ["a"], partitions=9)
    sizes = {r["part_idx"]: r["count"] for r in out.groupBy("part_idx").count().collect()}
    assert sizes == {i: 10 for i in range(1, 501)}


@pytest.fixture
def steps_as_rows(monkeypatch):
    """Step functions are composed as rows, however few steps they have."""
    monkeypatch.setattr(chunks, "FEW_STEPS", 0)


@pytest.mark.parametrize("threshold", [1, 11, 300, 5000])
def test_tree_with_many_levels(spark, steps_as_rows, threshold):
    check(spark, [("x", i, float(i % 5)) for i in range(800)], threshold, False, 13)


@pytest.mark.parametrize("threshold", [30, 4000])
def test_tree_over_several_keys(spark, steps_as_rows, threshold):
    rng = np.random.default_rng(6)
    rows = [(k, i, float(v)) for k, n in (("a", 500), ("b", 20), ("c", 300), (None, 90))
            for i, v in enumerate(rng.integers(0, 50, n))]
    check(spark, rows, threshold, True, 19)


def test_tree_with_negative_values(spark, steps_as_rows):
    rng = np.random.default_rng(9)
    for threshold in (60, 700):
        check(spark, [("x", i, float(v)) for i, v in enumerate(rng.integers(-20, 30, 900))], threshold, False, 11)


@settings(max_examples=200, deadline=None)
@given(st.one_of(numbers, signed), st.one_of(numbers, signed), st.integers(1, 40), st.integers(1, 7))
def test_steps_as_rows_compose_as_arrays_do(a, b, threshold, width):
    floor = 0 if min([0, *a, *b]) >= 0 else -30
    first, second = (steps_of(np.array(v, dtype=np.int64), threshold, floor) for v in (a, b))
    whole = then(first, second, floor)
    ceiling = int(first.low[0]) if len(first.low) else chunks.LIMIT
    rows = sorted([(int(o), 1, int(w), int(o), int(c)) for w, o, c in zip(*first[1:])]
                  + [(int(w), 0, int(w), int(o), int(c)) for w, o, c in zip(*second[1:])])
    found, last = [], chunks.Late()
    for at in range(0, len(rows), width):
        _, early, low, out, cuts = (np.array(x) for x in zip(*rows[at:at + width]))
        n = len(low)
        batch = pa.RecordBatch.from_pydict({
            "chain": pa.array([0] * n, pa.int32()), "parent": pa.array([0] * n, pa.int32()), "low": low, "out": out, "cuts": cuts,
            "late": early == 0, "early_total": np.full(n, first.total), "late_total": np.full(n, second.total),
            "ceiling": np.full(n, ceiling)})
        result, last = chunks._passed_on(batch, last, floor)
        found += [(r["low"], r["out"], r["cuts"]) for r in result.to_pylist()]
    found = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
    composed = chunks.Steps(whole.total, *found.T)
    for carry in range(floor, threshold):
        assert apply_steps(composed, carry) == apply_steps(whole, carry)


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        chunk_cumulative(spark.range(1), "id", 0, ["id"])


def test_fractions_do_not_depend_on_partitions(spark):
    values = [((i * 7919) % 97) / 10 for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v double").repartition(5)
    s, n, want = 0, 1, []
    for v in values:
        want.append(n)
        s += round(v * 10)
        if s >= 10:
            s, n = 0, n + 1
    for partitions in (1, 3, 8, 64):
        got = chunk_cumulative(df, "v", 1, ["pos"], partitions=partitions).orderBy("pos").collect()
        assert [r["part_idx"] for r in got] == want


def test_values_must_fit_the_scale(spark):
    df = spark.createDataFrame([(1, 0.25), (2, None), (3, float("nan"))], "pos long, v double")
    assert [r["part_idx"] for r in chunk_cumulative(df, "v", 0.25, ["pos"], scale=2).orderBy("pos").collect()] == [1, 2, 2]
    with pytest.raises(Exception, match="digits after the point"):
        chunk_cumulative(df, "v", 1, ["pos"], scale=1).collect()


def test_places_do_not_depend_on_the_order_rows_arrive_in(spark):
    rows = [(i % 7, str(i % 5), [float(i % 3)]) for i in range(400)]
    schema = "a int, b string, c array<double>"
    got = []
    for given in (rows, rows[::-1]):
        placed = with_place(spark.createDataFrame(given, schema).coalesce(1), "at")
        got.append(sorted(map(str, placed.collect())))
    assert got[0] == got[1] and len(set(got[0])) == 400
    kept = with_place(spark.createDataFrame([({"x": 1},), ({"x": 2},)], "m map<string,int>"), "at")
    assert len({r["at"] for r in kept.collect()}) == 2


def test_the_sort_before_numbers_stays(spark):
    df = with_place(spark.range(100).repartition(3), "at")
    assert plan_of(df.orderBy("id", "at")).count("Sort [") == 2
    assert plan_of(df.repartitionByRange(3, "id", "at")).count("Sort [") == 1
