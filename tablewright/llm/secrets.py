"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Base kinds: assignments to a secret-like name, access keys, long hexadecimal runs. Beyond
these, every run of 20 or more key characters that holds a digit is a candidate. A window
slides over it; its Shannon entropy is kept up to date by the counts of the one character that
leaves and the one that enters. Hexadecimal candidates and the rest have a window and a bound
of their own. What the allow-list matches is left out, as is what lies within a base span.
A candidate's span runs from its first window over the bound to its last.

Entropy is compared in whole numbers: a window of W characters has W log2 W - sum c log2 c
bits, each term rounded to a millionth, so no result hangs on the order of additions.

Only DataFrame functions are used; rows are independent, nothing is shuffled. Null text: read
as empty, no spans. Texts are scanned whole; positions count code points from 0, the end is
exclusive. Repeated rows get equal results, an empty table gives an empty one. Columns of the input
named base_spans or spans are replaced, any others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import fresh


def either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


# The base patterns; a match stands if it (or its group) is long enough.
ASSIGN = "(" + either_case("password|passwd|secret|token|api_?key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 8
# Runs of one class are matched whole, so their least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Strings that look like secrets but are known not to be.
ALLOWED = ("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|" + either_case("example|changeme|placeholder|dummy|redacted|your[_-]")
           + "|[xX]{6}|0123456789|1234567890|abcdefgh|ABCDEFGH|^sha(256|384|512)-|[*]{4}|/[a-z]+/[a-z]+/")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Of each character class: the window's characters and the least bits for each of them.
WINDOWS = {"hex": (20, 3.0), "base64": (24, 4.0)}


def bits(n: int) -> int:
    return round(n * math.log2(n) * 1_000_000) if n > 1 else 0


def most_repeats(kind: str) -> int:
    """The bound on the sum of c log2 c, in millionths."""
    width, least = WINDOWS[kind]
    return bits(width) - round(width * least * 1_000_000)


#: Matches whose places are added up in one go.
TOGETHER = 128


def places(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order, as structs of start, end and the matched text.

    A match begins where the lengths of all gaps and matches before it end. They are added up in
    groups of ``TOGETHER``, and the groups' sums on their own, so a text of many matches takes few steps for each.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    span = "struct<start:bigint,end:bigint,found:string>"
    none = F.array().cast(f"array<{span}>")

    def walk(group: Column) -> Column:
        """Where a group ends, counted from its start, and its matches."""
        return F.aggregate(
            group, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")),
            lambda s, x: F.struct(
                (s["at"] + F.length(x["g"]) + F.length(x["m"])).cast("long").alias("at"),
                F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["g"])).cast("long").alias("start"),
                                                    (s["at"] + F.length(x["g"]) + F.length(x["m"])).cast("long").alias("end"),
                                                    x["m"].alias("found")))).alias("out")))

    both = F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda x: x["m"].isNotNull())
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / TOGETHER).cast("int")), lambda i: walk(F.slice(both, i * TOGETHER + 1, TOGETHER)))
    empty = F.struct(F.array(F.lit(0).cast("long")).alias("starts"))
    starts = F.aggregate(groups, empty, lambda s, g: F.struct(F.concat(s["starts"], F.array(F.element_at(s["starts"], -1) + g["at"])).alias("starts")), lambda s: s["starts"])

    def moved(group: Column, at: Column) -> Column:
        return F.transform(group["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["found"].alias("found")))

    walked = F.when(F.size(groups) == 1, F.element_at(groups, 1)["out"]).otherwise(
        F.flatten(F.zip_with(groups, F.slice(starts, 1, F.size(groups)), moved)))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def entropic(found: Column, kind: str) -> Column:
    """First start and last end, within the string, of its windows over the bound; null if there are none."""
    width = WINDOWS[kind][0]
    table = F.array(*[F.lit(bits(n)).cast("long") for n in range(width + 2)])
    chars = F.split(found, "")

    def gain(count: Column) -> Column:
        """What the character that makes ``count`` of its kind adds to the sum."""
        return F.element_at(table, count + 1) - F.element_at(table, count)

    def same(begin: Column, size: Column, letter: Column, box: Column) -> Column:
        return F.size(F.filter(F.slice(box, begin + 1, size), lambda c: c == letter))

    def step(s: Column, j: Column) -> Column:
        box = s["chars"]
        enters, begin = F.element_at(box, j + 1), F.greatest(F.lit(0), j - (width - 1))
        added = gain(same(begin, j - begin + 1, enters, box))
        leaves = F.element_at(box, F.greatest(F.lit(1), j - (width - 1)))
        dropped = F.when(j >= width, gain(same(F.greatest(F.lit(0), j - width), F.lit(width), leaves, box))).otherwise(F.lit(0).cast("long"))
        total = s["total"] - dropped + added
        over = (j >= width - 1) & (total <= most_repeats(kind))
        return F.struct(box.alias("chars"), total.alias("total"), F.when(over, F.coalesce(s["first"], begin)).otherwise(s["first"]).alias("first"),
                        F.when(over, j + 1).otherwise(s["last"]).alias("last"))

    none = F.lit(None).cast("int")
    start = F.struct(F.filter(chars, lambda c: c != "").alias("chars"), F.lit(0).cast("long").alias("total"), none.alias("first"), none.alias("last"))
    return F.aggregate(F.sequence(F.lit(0), F.length(found) - 1), start, step, lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"], s["last"])))


def as_spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def entropy_spans(candidates: Column, kind: str) -> Column:
    width, rank, name = WINDOWS[kind][0], KINDS.index(f"entropy_{kind}"), f"entropy_{kind}"
    is_hex = "^[0-9a-fA-F]+$"
    able = F.filter(candidates, lambda x: (x["found"].rlike(is_hex) if kind == "hex" else ~x["found"].rlike(is_hex)) & (F.length(x["found"]) >= width)
                    & x["found"].rlike("[0-9]") & ~x["found"].rlike(ALLOWED))
    scored = F.transform(able, lambda x: F.struct(x["start"].alias("start"), entropic(x["found"], kind).alias("part")))
    return F.transform(F.filter(scored, lambda x: x["part"].isNotNull()),
                       lambda x: F.struct((x["start"] + x["part"]["first"]).cast("long").alias("start"), F.lit(rank).alias("rank"),
                                          (x["start"] + x["part"]["last"]).cast("long").alias("end"), F.lit(name).alias("kind")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with base_spans and spans: arrays of start, rank, end and kind, sorted."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("base_spans", "spans")]
    whole = F.coalesce(F.col(text), F.lit(""))
    own = {name: fresh(df, f"_{name}") for name in ("text", "assign", "access", "hex", "runs")}
    rows = df.select(*kept, whole.alias(own["text"]))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("runs", CANDIDATE)):
        rows = rows.withColumn(own[name], places(F.col(own["text"]), pattern))
    assign = F.filter(own["assign"], lambda x: F.length(F.regexp_extract(x["found"], f"^{ASSIGN}$", 2)) >= ASSIGN_LEAST)
    rows = rows.withColumn("base_spans", F.array_sort(F.concat(as_spans(assign, "assign"), as_spans(F.col(own["access"]), "access"), as_spans(F.col(own["hex"]), "hex"))))
    more = F.concat(entropy_spans(F.col(own["runs"]), "hex"), entropy_spans(F.col(own["runs"]), "base64"))
    new = F.filter(more, lambda x: ~F.exists("base_spans", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    return rows.withColumn("spans", F.array_sort(F.concat("base_spans", new))).select(*kept, "base_spans", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    def count(kind):
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    def found(kind, pattern):
        return f"""
{kind}_m as materialized (select id, regexp_extract_all(text, {quoted(pattern)}) as m, string_split_regex(text, {quoted(pattern)}) as g from docs where regexp_matches(text, {quoted(pattern)})),
{kind}_p as (select id, i, m[i] as found, length(m[i]) as n, length(g[i]) as gap from (select id, m, g, unnest(range(1, len(m) + 1)) as i from {kind}_m)),
{kind}_s as (select id, found, (sum(gap + n) over (partition by id order by i))::bigint as e, n from {kind}_p)"""

    def entropy(kind):
        width = WINDOWS[kind][0]
        which = "" if kind == "hex" else "not "
        table = "[" + ", ".join(str(bits(n)) for n in range(width + 2)) + "]"
        return f"""
{kind}_c as materialized (select id, e - n as s, found, row_number() over () as k from runs_s where {which}regexp_full_match(found, '[0-9a-fA-F]+') and n >= {width}
  and regexp_matches(found, '[0-9]') and not regexp_matches(found, {quoted(ALLOWED)})),
{kind}_w as (select k, w, ch, count(*) as c from (select k, w, unnest(string_split(substr(found, (w + 1)::int, {width}), '')) as ch
  from (select k, found, unnest(range(length(found) - {width - 1})) as w from {kind}_c)) where ch <> '' group by all),
{kind}_o as (select k, min(w) as a, max(w) + {width} as z from (select k, w from {kind}_w group by all having sum(({table})[(c + 1)::int]) <= {most_repeats(kind)}) group by k),
{kind}_e as (select id, s + a as s, s + z as e from {kind}_c join {kind}_o using (k))"""

    base = " union all ".join(f"select id, e - n as s, {i} as r, e, '{k}' as kind from {k}_s" + (
        f" where length(regexp_extract(found, {quoted('^' + ASSIGN + '$')}, 2)) >= {ASSIGN_LEAST}" if k == "assign" else "") for i, k in enumerate(KINDS[:3]))
    more = " union all ".join(f"select id, s, {KINDS.index('entropy_' + k)} as r, e, 'entropy_{k}' as kind from {k}_e" for k in WINDOWS)
    text = "string_agg(kind || ':' || s::varchar || ':' || e::varchar, ',' order by s, r, e)"
    return f"""with docs as materialized (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
{",".join([found("assign", ASSIGN), found("access", ACCESS), found("hex", HEX), found("runs", CANDIDATE), entropy("hex").replace("hex_", "ehex_"), entropy("base64")])},
base as materialized ({base}),
extra as ({more.replace("from hex_e", "from ehex_e")}),
added as (select * from extra where not exists (select 1 from base where base.id = extra.id and base.s <= extra.s and base.e >= extra.e)),
b as (select id, count(*) filter (kind = 'assign') as na, count(*) filter (kind = 'access') as nk, count(*) filter (kind = 'hex') as nh, {text} as t from base group by id),
a as (select id, {text} as t from (select * from base union all select * from added) group by id)
select doc_id, coalesce(na, 0) as n_assign, coalesce(nk, 0) as n_access, coalesce(nh, 0) as n_hex, sha256(coalesce(b.t, '')) as base_sha256, coalesce(a.t, '') as spans
from docs left join b using (id) left join a using (id)"""


#: The same rows in DuckDB's SQL.
SQL = _sql()
