"""Files cut at true record borders, with splits of a few bytes."""

import csv
import io
import json
import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from tablewright import csv_to_json, read_any, read_sniffed
from tablewright.sources.files import json_kinds, read_csv_text
from tablewright.sources.records import CsvLines, JsonElements, array_elements, csv_records


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def cells(rnd, n):
    return ["".join(rnd.choices(["a", "b", '"', ",", "\n", " ", "é", '""', "\n\n", "1"], k=rnd.randint(0, 12))) for _ in range(n)]


def test_csv_like_the_csv_module(spark, tmp_path, small_splits):
    rnd = random.Random(4)
    rows = [[str(i), *cells(rnd, 2)] for i in range(120)] + [["900", "x\n" * 100, "long"], ["901", "", "last"]]
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(2):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerows([["id", "s", "t"], *rows[k::2]])
        (folder / f"{k}.csv").write_text(out.getvalue(), newline="")
    df = read_any(spark, str(folder), quote='"')
    assert df.rdd.getNumPartitions() > 20
    got = sorted((r["id"], r["s"] or "", r["t"] or "") for r in df.collect())
    assert got == sorted((int(a), b, c) for a, b, c in rows)
    typed = read_any(spark, str(folder), schema="id long, s string, t string")
    assert sorted((r["id"], r["s"] or "") for r in typed.select("id", "s").collect()) == sorted((int(a), b) for a, b, _ in rows)


@pytest.mark.parametrize("quote,escape", [('"', '"'), ("'", "'"), ('"', "\\"), ("'", "\\")])
def test_quotes_and_escapes(spark, tmp_path, small_splits, quote, escape):
    held = "two\nlines " + escape + quote + " of it"
    (tmp_path / "q.csv").write_text(f"a,b\n{quote}{held}{quote},1\n" + f"{quote}x\ny{quote},2\nplain,3\n" * 9)
    df = read_any(spark, str(tmp_path / "q.csv"), quote=quote, escape=escape)
    assert sorted(map(tuple, df.collect())) == sorted([(f"two\nlines {quote} of it", 1)] + [("x\ny", 2), ("plain", 3)] * 9)


def test_a_stray_quote_opens_nothing(spark, tmp_path, small_splits):
    lines = ['id,size,t'] + [f'{i},5" disk,"x\ny"' for i in range(30)] + ['99,7" disk,z']
    (tmp_path / "s.csv").write_text("\n".join(lines))
    rows = [r["value"] for r in csv_records(spark, str(tmp_path / "s.csv"), ",", '"', '"').collect()]
    assert sorted(rows) == sorted(lines)


def test_line_outcomes():
    kind = CsvLines()
    assert [kind.open_after(x, False) for x in ["", "a,b", '"a"', '"a', 'a,"b', 'a"b', '"a""b"', '"a"",', 'a,"b",c,"']] == [
        False, False, False, True, True, False, False, True, True]
    assert [kind.open_after(x, True) for x in ["", "a", 'a"', 'a""', '""",b', 'a",b,"c', 'a","b"']] == [True, True, False, True, False, True, False]


def test_json_arrays_like_the_json_module(spark, tmp_path, small_splits):
    rnd = random.Random(9)
    words = ["x", '}', "{", "]", "[", '"', "\\", "é", "\\\"", "},{", " ", "\n", ","]

    def value(depth):
        kind = rnd.randint(0, 4)
        if depth and kind == 0:
            return [value(depth - 1) for _ in range(rnd.randint(0, 3))]
        if depth and kind == 1:
            return {rnd.choice("abc}"): value(depth - 1) for _ in range(rnd.randint(0, 3))}
        return rnd.choice([None, 1, 2.5, True, "".join(rnd.choices(words, k=6))])

    rows = [{"id": i, "v": value(3)} for i in range(80)] + [{"id": 80, "v": "z}" * 200}, {}]
    for name, text in {"one": json.dumps(rows), "pretty": json.dumps(rows, indent=2), "none": "[]", "tight": json.dumps(rows, separators=(",", ":"), ensure_ascii=False)}.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        elements = array_elements(spark, str(path))
        got = sorted((json.loads(r["value"]) for r in elements.collect()), key=lambda r: r.get("id", -1))
        assert got == ([] if name == "none" else sorted(rows, key=lambda r: r.get("id", -1)))
        assert name == "none" or elements.rdd.getNumPartitions() > 10
    df = read_any(spark, str(tmp_path / "one.json"))
    assert sorted(r["id"] for r in df.collect() if r["id"] is not None) == list(range(81)) and df.count() == 82
    assert read_any(spark, str(tmp_path / "pretty.json"), schema="id long").agg(F.sum("id")).first()[0] == sum(range(81))


def test_state_of_strings_and_brackets():
    import pyarrow as pa

    kind = JsonElements()
    units = pa.array(['[{"a":"}', '","b":{"c":[1,2]', "", ', {"d":"\\\\"', '\n]'])
    ends, state = kind.ends(units, kind.begin)
    assert ends.tolist() == [False, False, True, True, False] and state == (False, -1)


def test_damaged_lines_lose_only_themselves(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": 1, "b"\n{"a": 2}\n{"a": 3}\n{"a": 4}\n')
    assert [r["kind"] for r in json_kinds(spark, str(tmp_path / "d.json")).collect()] == ["lines"]
    assert sorted(r["a"] for r in read_any(spark, str(tmp_path / "d.json"), schema="a int").collect() if r["a"]) == [2, 3, 4]
    df = read_any(spark, str(tmp_path / "d.json"))
    assert sorted((r["a"] or 0, r["_corrupt_record"] or "") for r in df.collect()) == [(0, '{"a": 1, "b"'), (2, ""), (3, ""), (4, "")]
    (tmp_path / "o.json").write_text('{\n "items": [\n  {"a": 1},\n  {"a": 2}\n ]\n}\n')
    assert [r["kind"] for r in json_kinds(spark, str(tmp_path / "o.json")).collect()] == ["object"]
    assert len(read_any(spark, str(tmp_path / "o.json")).first()["items"]) == 2


def test_text_cells_of_long_files(spark, tmp_path, small_splits):
    (tmp_path / "w.csv").write_text('id;name\n' + '1;"a\nb";extra\n2; c \n' * 12)
    out = read_csv_text(spark, str(tmp_path / "w.csv"), ";")
    assert out.columns == ["id", "name", "column_2"]
    assert tuples(out.distinct()) == [("1", "a\nb", "extra"), ("2", "c", None)] and out.count() == 24
    csv_to_json(spark, str(tmp_path / "w.csv"), str(tmp_path / "w.jsonl"), ";")
    assert read_any(spark, str(tmp_path / "w.jsonl")).count() == 24
    assert read_sniffed(spark, str(tmp_path / "w.csv")).count() == 24


def test_a_late_text_cell_makes_a_text_column(spark, tmp_path):
    (tmp_path / "late.csv").write_text("a,b,c\n" + "1,2.5,x\n" * 1500 + "1,oops,y\n,3,z\n")
    assert [t for _, t in read_any(spark, str(tmp_path / "late.csv")).dtypes] == ["bigint", "string", "string"]
