"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources in code point order, null last, weigh 3, 1, 2, repeating, and share ``share`` times all
words. A target stops at ``most`` times its source's size; what is over is shared again by
weight among the rest. The mix is counted in blocks of equal words: blocks go to the sources
by highest quotients target / (2 j + 1), and a source's blocks go to its shards in the same
way, by the shards' words. Within a shard the documents stand in a seeded order, and the
shard's quota is the run of blocks from a seeded place on, round and round: every word is
taken equally often but for one, so no document is taken more than ``most`` times.

A block has 1 to ``MOST_BLOCK`` words, a 2,000th of the smallest target. There is a shard for
every ``SHARD_WORDS`` words, ``LEAST_SHARDS`` at least; rows go to shards by a hash of doc_id.
Apart from sources (one row each) nothing is gathered in one task. Only DataFrame functions
are used.

Null text: size 0, none taken. Null source: a source of its own, the last. Null doc_id: hashed
as the empty text. Repeated rows are rows of their own; rows equal in doc_id and size are
interchangeable, so reruns agree. An empty table gives an empty one; with no words at all
targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import fresh
from tablewright.llm.scratch import Scratch
from tablewright.sources.scratch import cut_lineage

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
MOST_BLOCK = 1024
SHARD_WORDS = 4_000_000
LEAST_SHARDS = 64
#: Words of a source's shard where documents stay whole.
OWN_SHARD_WORDS = 1_000_000
SEED = "mix-7"


def seeded(*parts: Column) -> Column:
    """Hex digits drawn for the parts, the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary"))


def number(digits: Column) -> Column:
    return F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")


def apportion(df: DataFrame, group: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """``df`` with the seats of each row: of each group's ``seats`` the highest weight / (2 j + 1) get one.

    Seats that differ between any two divisors in question are ranked; a row's share of them
    follows its weight, so a group ranks about as many quotients as it has rows.
    """
    whole = Window.partitionBy(*group)
    share = F.try_divide(F.col(weight), F.sum(weight).over(whole))
    near = F.floor(F.coalesce(F.col(seats) * share, F.lit(0)) + 0.5)
    reach = F.ceil(F.coalesce(F.count(F.lit(1)).over(whole) * share / 2, F.lit(0))) + 2
    placed = df.withColumns({"_near": near, "_reach": reach})
    placed = placed.withColumn("_sure", F.greatest(F.lit(0), F.col("_near") - F.col("_reach")))
    placed = placed.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    tried = placed.select(*group, key, "_open", F.col(weight).alias("_w"), F.explode(F.sequence(F.col("_sure"), F.col("_near") + F.col("_reach"))).alias("_j"))
    order = Window.partitionBy(*group).orderBy((F.col("_w") / (2 * F.col("_j") + 1)).desc(), F.col(key).asc_nulls_last(), "_j")
    won = tried.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _open and _w > 0")
    won = won.groupBy(*[F.col(c).alias(f"_g_{c}") for c in [*group, key]]).agg(F.count(F.lit(1)).alias("_won"))
    same = [placed[c].eqNullSafe(won[f"_g_{c}"]) for c in [*group, key]]
    return placed.join(won, same, "left").select(*df.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out))


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, own_shards: bool = False) -> DataFrame:
    """One row for each source: source, source_size, target, block, shards (``own_shards``: by the source's words) and its blocks."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    full = F.coalesce(F.sum(most * F.col("source_size")).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    # the level of water once the sources before are full; it is highest at the true level
    each = each.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", (share * F.col("total") - full) / rest)
    each = each.withColumn("level", F.max("level").over(everything))
    each = each.withColumn("target", F.least(F.col("level") * F.col("weight"), (most * F.col("source_size")).cast("double")))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    each = each.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.coalesce(F.floor(least / 2000), F.lit(1)))))
    own = F.greatest(F.lit(1), F.ceil(F.col("source_size") / OWN_SHARD_WORDS))
    each = each.withColumn("shards", own if own_shards else F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("total") / SHARD_WORDS)))
    each = each.withColumn("all_blocks", F.floor(share * F.col("total") / F.col("block") + 0.5))
    each = apportion(each, [], "source", "target", "all_blocks", "blocks")
    return each.select("source", "source_size", "target", "block", "shards", "blocks")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, text: str = "text", keep: list[str] | None = None, from_first: bool = False) -> DataFrame:
    """``docs`` (``keep``: only these columns, their sizes being counted in one pass) with size, source_size, target and taken.

    ``docs`` needs doc_id, source and the text column; new columns replace those of the same name.
    ``from_first``: a shard's quota begins with the first document of its seeded order, and shards are as many as the
    source's own words ask for, one for a small source. One document of a shard is cut at most, where the quota ends, and
    what is taken of it is its head.
    """
    new = {"size", "source_size", "target", "taken"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new and c not in ("doc_id", "source")]
    mark = fresh(docs, "mix_place")
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size")
    if kept:
        # Texts stay where they are until the end. Rows are numbered once, on disk: numbers drawn again in
        # a second read would be others if its partitions were cut differently.
        docs = Scratch(docs.sparkSession).result(docs.select("doc_id", "source", *kept, size, F.monotonically_increasing_id().alias(mark)))
        sized = docs.select("doc_id", "source", "size", F.col(mark).alias("_place"))
    else:
        sized = cut_lineage(docs.select("doc_id", "source", size))
    narrow = sized.select("doc_id", "source", "size")
    by_source = cut_lineage(targets(narrow, share, most, from_first))
    drawn = seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_draw", drawn).withColumn("_shard", F.pmod(number(F.col("_draw")), "shards"))
    cells = rows.groupBy("source", "_shard", "block", "blocks").agg(F.sum("size").alias("_words"))
    quotas = apportion(cells, ["source", "blocks"], "_shard", "_words", "blocks", "_quota")
    quotas = quotas.withColumn("_take", F.least(F.col("_quota") * F.col("block"), most * F.col("_words")))
    first = F.pmod(number(seeded(F.coalesce("source", F.lit("")), F.col("_shard").cast("string"))), F.greatest("_words", F.lit(1)))
    quotas = quotas.withColumn("_first", F.lit(0) if from_first else F.floor(first / F.col("block")) * F.col("block"))
    quotas = quotas.select(F.col("source").alias("_source"), F.col("_shard").alias("_of"), "_words", "_take", "_first")
    order = Window.partitionBy("source", "_shard").orderBy("_draw", "doc_id", "size", *(["_place"] if kept else []))
    placed = rows.withColumn("_begin", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_of")))

    def passed(place: Column) -> Column:
        """Words of the document among the first ``place`` words of the shard, repeated without end."""
        rounds = F.floor(F.try_divide(place, F.col("_words")))
        inside = place - rounds * F.col("_words") - F.col("_begin")
        return rounds * F.col("size") + F.greatest(F.lit(0), F.least(inside, F.col("size")))

    taken = F.when(F.col("_words") > 0, passed(F.col("_first") + F.col("_take")) - passed(F.col("_first"))).otherwise(0)
    placed = placed.withColumn("taken", taken.cast("long"))
    if not kept:
        return placed.select("doc_id", "source", *sorted(new, key=["size", "source_size", "target", "taken"].index))
    at = fresh(docs, "mix_at")
    found = placed.select(F.col("_place").alias(at), "size", "source_size", "target", "taken")
    whole = docs.select(mark, "doc_id", "source", *kept)
    return whole.join(found.hint("merge"), F.col(mark) == F.col(at)).drop(mark, at)


#: The same rows in DuckDB's SQL.
SQL = f"""
with sized as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from sized group by source),
s1 as (select *, [3, 1, 2][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as weight from s0),
s2 as (select *, (sum(source_size) over ())::bigint as total,
  (1.5 * (sum(source_size) over ()) - coalesce(sum(2 * source_size) over (order by source_size / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by source_size / weight, encode(source) nulls last rows between current row and unbounded following) as lvl from s1),
s3 as (select *, least((max(lvl) over ()) * weight, (2 * source_size)::double) as target from s2),
s4 as (select *, greatest(1, least({MOST_BLOCK}, coalesce(floor((min(case when target > 0 then target end) over ()) / 2000), 1)))::bigint as block,
  greatest({LEAST_SHARDS}, ceil(total / {SHARD_WORDS}.0))::bigint as shards from s3),
s5 as (select *, floor(1.5 * total / block + 0.5)::bigint as seats, target / nullif(sum(target) over (), 0) as part, count(*) over () as n from s4),
s6 as (select *, floor(coalesce(seats * part, 0) + 0.5)::bigint as near, ceil(coalesce(n * part / 2, 0))::bigint + 2 as reach from s5),
s7 as (select *, greatest(0, near - reach) as sure from s6),
s8 as (select *, seats - sum(sure) over () as free from s7),
s9 as (select source, free, target, unnest(range(sure, near + reach + 1)) as j from s8),
s10 as (select *, row_number() over (order by target / (2 * j + 1) desc, encode(source) nulls last, j) as place from s9),
s11 as (select source, count(*) as won from s10 where place <= free and target > 0 group by source),
sources as (select s8.source, source_size, target, block, shards, (sure + coalesce(won, 0))::bigint as blocks
  from s8 left join s11 on s8.source is not distinct from s11.source),
rows0 as materialized (select sized.doc_id, sized.source, size, source_size, target, block, shards, blocks,
  md5('{SEED}|' || coalesce(doc_id::varchar, '')) as draw from sized join sources on sized.source is not distinct from sources.source),
rows1 as (select *, ('0x' || substr(draw, 1, 15))::bigint % shards as shard from rows0),
c0 as (select source, shard, block, blocks, sum(size)::bigint as words from rows1 group by all),
c1 as (select *, words / nullif(sum(words) over (partition by source), 0) as part, count(*) over (partition by source) as n from c0),
c2 as (select *, floor(coalesce(blocks * part, 0) + 0.5)::bigint as near, ceil(coalesce(n * part / 2, 0))::bigint + 2 as reach from c1),
c3 as (select *, greatest(0, near - reach) as sure from c2),
c4 as (select *, blocks - sum(sure) over (partition by source) as free from c3),
c5 as (select source, shard, free, words, unnest(range(sure, near + reach + 1)) as j from c4),
c6 as (select *, row_number() over (partition by source order by words / (2 * j + 1) desc, shard, j) as place from c5),
c7 as (select source, shard, count(*) as won from c6 where place <= free and words > 0 group by all),
c8 as (select c4.source, c4.shard, words, least((sure + coalesce(won, 0)) * block, 2 * words)::bigint as take,
  ((('0x' || substr(md5('{SEED}|' || coalesce(c4.source, '') || '|' || c4.shard::varchar), 1, 15))::bigint % greatest(words, 1)) // block * block)::bigint as fst
  from c4 left join c7 on c4.source is not distinct from c7.source and c4.shard = c7.shard),
d0 as (select *, (sum(size) over (partition by source, shard order by draw, doc_id, size rows between unbounded preceding and current row) - size)::bigint as beg from rows1),
d1 as (select d0.*, words, fst, fst + take as lst from d0 join c8 on d0.source is not distinct from c8.source and d0.shard = c8.shard)
select doc_id, size, source_size, target, (case when words > 0 then
    lst // words * size + greatest(0, least(lst % words - beg, size)) - fst // words * size - greatest(0, least(fst % words - beg, size))
  else 0 end)::bigint as taken from d1
"""
