"""Line dedup by winnowing over line hashes.

A text's lines are hashed, white space (U+0020, U+0009 to U+000D) at their ends left out; lines
without words stand aside. A block is the shortest run of lines from a line on that has
``LEAST_WORDS`` words; the line with the smallest hash in it is the block's fingerprint (of
equal ones the last). Equal blocks have equal fingerprints, so every run of that many words
that stands elsewhere shares one: winnowing's guarantee.

Fingerprints at one place only are gone after one aggregate. The blocks of the others go on;
their positions are joined to the first one of the same content (by doc_id, hash of the text,
line), and what comes later is a match. Matches that overlap or touch grow together both ways
into runs, and the runs' lines are deleted. A block that overlaps its own first occurrence
gives only the lines behind it. So a line goes if and only if it stands in a run of
``LEAST_WORDS`` words that occurs earlier.

Null text: no lines, stays null. Null doc_id: smaller than any other. Rows equal in doc_id and
text count as one document and get equal results. A text of any length is one document's
lines; nothing else is gathered. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm.common import add_columns, fresh, text_slices
from tablewright.llm.scratch import Scratch

LEAST_WORDS = 50
BLOCKS = "blocks array<struct<mark:bigint,fresh:boolean,high:bigint,low:bigint,first:int,end:int>>"
RUNS = "array<struct<begin:int,end:int>>"


def blocks_of(text: str | None, least: int = LEAST_WORDS) -> list[tuple[int, bool, int, int, int, int]]:
    """Fingerprint, whether it is at another line than the block's before, two halves of the content's hash, first line, end."""
    lines = [(i, s, len(s.split())) for i, s in enumerate(x.strip() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n"))]
    lines = [x for x in lines if x[2]]
    ends = np.cumsum([0] + [n for _, _, n in lines])
    if ends[-1] < least:
        return []
    marks = np.array([xxhash.xxh64_intdigest(s) for _, s, _ in lines], np.uint64).view(np.int64)
    out, before = [], -1
    for a, z in enumerate(np.searchsorted(ends, ends[:-1] + least).tolist()):
        if z >= len(ends):
            break
        at = z - 1 - int(marks[a:z][::-1].argmin())
        whole = xxhash.xxh3_128_digest(b"\n".join([s for _, s, _ in lines[a:z]]))
        out.append((int(marks[at]), at != before, int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True), lines[a][0], lines[z - 1][0] + 1))
        before = at
    return out


def with_blocks(df: DataFrame, text: str, least: int) -> DataFrame:
    kind = pa.struct([("mark", pa.int64()), ("fresh", pa.bool_()), ("high", pa.int64()), ("low", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def scan(column):
        each = [blocks_of(t, least) for t in column.to_pylist()]
        flat = [b for bs in each for b in bs]
        rows = pa.StructArray.from_arrays([pa.array([b[i] for b in flat], f.type) for i, f in enumerate(kind)], fields=list(kind))
        return [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(bs) for bs in each]), pa.int32()), rows)]

    return add_columns(df, text, BLOCKS, lambda: scan)


def later_blocks(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, print (hash of the text) and spans (first and end line of what stands earlier too) of documents that have any."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"))
    blocks = with_blocks(named, "text", least).filter("size(blocks) > 0")
    placed = scratch.keep(blocks.select("doc_id", "print", F.explode("blocks").alias("b")).select("doc_id", "print", "b.*"))
    # joined by sorted merges at every size: Spark splits their hot keys, and nothing that grows is broadcast
    often = placed.filter("fresh").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    near = scratch.keep(placed.drop("fresh").join(scratch.keep(often).hint("merge"), "mark", "left_semi").drop("mark"))
    here = F.struct("doc_id", "print", "first", "end")
    firsts = near.groupBy("high", "low").agg(F.min(here).alias("f"), F.max(here).alias("l")).filter("f <> l").drop("l")
    found = near.join(scratch.keep(firsts).hint("merge"), ["high", "low"]).filter(here != F.col("f"))
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("print") == F.col("f.print"))
    found = found.withColumn("begin", F.when(same, F.greatest("first", "f.end")).otherwise(F.col("first"))).filter("begin < end")
    return found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def grow(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one run each, in order."""
    runs: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if runs and runs[-1][1] >= begin:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([begin, end])
    return [tuple(r) for r in runs]


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """The lines in none of the runs."""
    lines, at, kept = text.split("\n"), 0, []
    for begin, end in runs:
        kept += lines[at:begin]
        at = end
    return "\n".join(kept + lines[at:])


def dedup_lines(docs: DataFrame, runs: str = "runs", least: int = LEAST_WORDS) -> DataFrame:
    """``docs``, their text without the later copies of runs of lines, and a column of the runs (begin, end) that went."""
    with Scratch(docs.sparkSession) as scratch:
        mark, an_id, a_print, gone = (fresh(docs, c) for c in ("text_print", "run_id", "run_print", "run_spans"))
        found = scratch.result(later_blocks(docs, scratch, least=least).select(F.col("doc_id").alias(an_id), F.col("print").alias(a_print), F.col("spans").alias(gone)))
        hashed = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
        joined = hashed.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col(an_id)) & (F.col(mark) == F.col(a_print)), "left")
        kept = [c for c in docs.columns if c.lower() != runs.lower()]
        schema = StructType([docs.schema[c] for c in kept] + list(StructType.fromDDL(f"`{runs}` {RUNS}")))
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

        def work(batches):
            for batch in batches:
                for part in text_slices(batch, "text"):
                    each = [grow(s or []) for s in part.column(gone).to_pylist()]
                    texts = part.column("text")
                    if any(each):
                        texts = pa.array([cut(t, r) if r else t for t, r in zip(texts.to_pylist(), each, strict=True)], pa.string())
                    rows = pa.array([[{"begin": a, "end": z} for a, z in r] for r in each], kind)
                    yield pa.RecordBatch.from_arrays([texts if c == "text" else part.column(c) for c in kept] + [rows], names=schema.names)

        return joined.select(*kept, gone).mapInArrow(work, schema)


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_deleted (lines), runs as text and the digest of the text that is left."""
    return cleaned.select("doc_id", F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"]).alias("n_deleted"),
                          F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["begin"].cast("string"), r["end"].cast("string"))), ",").alias("runs"),
                          F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: The same rows in DuckDB's SQL, for unique doc_ids.
SQL = rf"""
with l0 as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
l1 as materialized (select doc_id, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as s, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l0),
l2 as (select doc_id, i, s, row_number() over w as k, sum(n) over w as c, sum(n) over w - n as c0 from l1 where n > 0 window w as (partition by doc_id order by i)),
whole as materialized (select doc_id, list(s order by k) as ss from l2 group by doc_id),
b0 as (select a.doc_id, a.k, z.k as kz, a.i as fst, z.i + 1 as lst from l2 a asof join l2 z on a.doc_id = z.doc_id and a.c0 + {LEAST_WORDS} <= z.c),
b1 as (select b0.doc_id, fst, lst, md5(array_to_string(ss[k:kz], chr(10))) as h from b0 join whole using (doc_id)),
b2 as (select *, first_value(doc_id) over w as fd, first_value(fst) over w as ff, first_value(lst) over w as fl from b1 window w as (partition by h order by doc_id, fst)),
spans as (select doc_id, case when fd = doc_id then greatest(fst, fl) else fst end as b, lst as e from b2 where not (fd = doc_id and ff = fst)),
gone as materialized (select distinct l1.doc_id, i from l1 join spans on l1.doc_id = spans.doc_id and i >= b and i < e),
isles as (select doc_id, min(i) as a, max(i) + 1 as z from (select doc_id, i, i - row_number() over (partition by doc_id order by i) as g from gone) group by doc_id, g),
r as (select doc_id, sum(z - a)::bigint as n_deleted, string_agg(a::varchar || '-' || z::varchar, ',' order by a) as runs from isles group by doc_id),
t as (select doc_id, string_agg(line, chr(10) order by i) as text from l1 anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_deleted, 0) as n_deleted, coalesce(runs, '') as runs, sha256(coalesce(t.text, '')) as text_sha256
from documents d left join r using (doc_id) left join t using (doc_id)
"""
