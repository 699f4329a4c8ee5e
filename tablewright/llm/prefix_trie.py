"""The trie of conversations that begin alike.

Each conversation is a sequence of turns; a node is a distinct first d turns, the root has none. Nodes are
known by a running digest: the sum over their turns of a digest of depth, role and text, of
128 bits, so that a conversation of any length is taken by many tasks.

A node where no conversation ends and which all go on with the same turn has the members of the
next one. Of such a chain only the last node goes into the tree. Conversations as paths of those nodes, in
the order of the paths, are cut into shards. A shard is the balanced parentheses of its part of
the tree: close-finding by range minima delimits subtrees, rank counts leaf pairs, and cumulative
arrays over the opens give the savings. What the conversation before a shard shares with its first one is
open there already and counts nothing; nodes that reach over shards are added up.

A path of n nodes takes n(n+1)/2 turns, as at each node a conversation ends or leaves; so it is short against the table.
Nodes with one member need no tree: their subtree is a chain.

Turns come in the order of their number, null first, equal ones by role and then by a digest of the text.
Null role and text are empty. Repeated turns are turns of their own. Turns without conv_id belong to no
conversation and are left out. An empty table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm.parentheses import Parentheses
from tablewright.llm.running import running
from tablewright.llm.scratch import Scratch

ROOT = ""
#: Steps of paths in a shard, a longer path alone.
SHARD_STEPS = 1 << 19
NOTHING = hashlib.sha256(b"").hexdigest()
DIGEST = ("s1", "s2", "s3", "s4")


def narrow(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and, for the text, two digests and its length in code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), F.length(text).cast("long").alias("size"))


def in_order(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """The narrow turns with ``depth``, their place in the conversation from 1."""
    rows = narrow(turns).withColumns({"one": F.lit(1).cast("long"), "place": F.monotonically_increasing_id()})
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2"), F.col("place")]
    return running(scratch, rows, "conv_id", order, {"depth": "one"}).select("conv_id", "depth", "t1", "t2", "size")


def rebuilt(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of conversation c - c % 100: conv_ids, and the turns with their depth.

    c begins with the first h turns of that one, h = crc32(decimal c) % 6, as many as there are; its own
    turns after its first h follow.
    """
    own = scratch.keep(in_order(scratch, turns))
    ids = own.groupBy("conv_id").agg(F.max("depth").alias("n"))
    at = F.col("conv_id")
    ids = ids.withColumns({"h": F.crc32(at.cast("string").cast("binary")) % 6, "base": at - at % 100})
    bases = ids.filter("conv_id = base").select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"))
    ids = scratch.keep(ids.join(bases, F.col("base") == F.col("_base"), "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken")))
    # at most five turns of a base, for at most a hundred conversations
    heads = own.filter("depth <= 5 and conv_id % 100 = 0").withColumnRenamed("conv_id", "_base")
    heads = heads.join(ids, (F.col("base") == F.col("_base")) & (F.col("depth") <= F.col("taken")))
    tails = own.join(ids.withColumnRenamed("conv_id", "_c"), F.col("conv_id") == F.col("_c")).filter("depth > h")
    tails = tails.withColumn("depth", F.col("depth") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "depth", "t1", "t2", "size"]
    return ids.select("conv_id"), heads.select(*columns).unionByName(tails.select(*columns))


def chained(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, depth, its node, the node before, its size and that of all turns so far."""
    halves = {}
    for k, digest in enumerate((F.xxhash64("depth", "t1", "t2"), F.xxhash64(F.lit(1), "t2", "depth", "t1"))):
        halves[f"d{2 * k + 1}"] = digest.bitwiseAND(F.lit(0xFFFFFFFF))
        halves[f"d{2 * k + 2}"] = F.shiftrightunsigned(digest, 32)
    rows = rows.select("conv_id", "depth", "size", *[v.alias(c) for c, v in halves.items()])
    added = running(scratch, rows, "conv_id", [F.col("depth")], {**{s: f"d{k + 1}" for k, s in enumerate(DIGEST)}, "so_far": "size"})

    def name(parts: list[Column]) -> Column:
        return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))

    before = name([F.col(s) - F.col(f"d{k + 1}") for k, s in enumerate(DIGEST)])
    return added.select("conv_id", "depth", "size", "so_far", name([F.col(s) for s in DIGEST]).alias("node"),
                        F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(before).alias("parent"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """A row for each node but the root: its smallest member ``first``, members ``n``, children, and ``ends_chain``."""
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), *[F.any_value(c).alias(c) for c in ("depth", "parent", "size", "so_far")])
    below = nodes.groupBy(F.col("parent").alias("_parent")).agg(F.count(F.lit(1)).alias("n_children"), F.max("n").alias("_most"))
    joined = nodes.join(below, F.col("node") == F.col("_parent"), "left")
    return joined.select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.coalesce("_most", F.lit(0)) < F.col("n")).alias("ends_chain"))


def paths_of(ids: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each conversation as the chain ends it passes, from the root on."""
    ends = nodes.filter("ends_chain").select(F.col("node").alias("_node"), "n", "first", "so_far", (F.col("n_children") == 0).alias("leaf"))
    passed = rows.select("conv_id", "depth", "node").join(ends, F.col("node") == F.col("_node"))
    step = F.struct("depth", "node", "n", "first", "so_far", "leaf")
    paths = passed.groupBy(F.col("conv_id").alias("_c")).agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    steps = F.coalesce("_steps", F.array().cast(paths.schema["_steps"].dataType))
    both = ids.join(paths, F.col("conv_id") == F.col("_c"), "left").select("conv_id", steps.alias("steps"))
    return both.select("conv_id", F.col("steps.node").alias("path"),
                       *[F.col(f"steps.{c}").alias(c) for c in ("n", "first", "so_far", "leaf")])


def in_shards(scratch: Scratch, paths: DataFrame) -> DataFrame:
    """The paths in order, cut into shards; each shard has the last conversation of the one before as its row -1."""
    def mark(batches):
        shard, row, steps = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            sizes = batch.column("path").value_lengths().fill_null(0).to_pylist()
            shards, rows = [], []
            for size in sizes:
                if steps and steps + size > SHARD_STEPS:
                    shard, row, steps = shard + 1, 0, 0
                shards.append(shard)
                rows.append(row)
                row, steps = row + 1, steps + size + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.int64()), pa.array(rows, pa.int64())], names=[*batch.schema.names, "shard", "row"])

    dealt = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = scratch.keep(dealt.mapInArrow(mark, StructType([*dealt.schema.fields, *StructType.fromDDL("shard long, row long")])))
    last = rows.groupBy("shard").agg(F.max(F.struct("row", "conv_id", "path")).alias("end"))
    lead = last.withColumn("shard", F.lead("shard").over(Window.orderBy("shard"))).filter("shard is not null")
    lead = lead.select("end.conv_id", "end.path", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("n", "first", "so_far", "leaf")],
                       "shard", F.lit(-1).cast("long").alias("row"))
    return rows.unionByName(lead)


SHARD_FIELDS = "node string, n long, first long, so_far long, leaves long, saved long, spine boolean, n_ends long, ends string, shard long"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return column.flatten(), np.r_[0, np.cumsum(sizes)]


def encode_shard(table: pa.Table) -> pa.Table:
    """The nodes of a shard, with the leaves and the savings strictly below them there, and who ends at them.

    ``spine``: the node may reach into other shards; ``ends`` are then conv_ids in order, else their digest.
    """
    table = table.sort_by("row")
    shard, lead = table.column("shard")[0].as_py(), None
    if table.column("row")[0].as_py() < 0:
        lead, table = table.column("path")[0].as_py(), table.slice(1)
    ids = table.column("conv_id").to_pylist()
    names, starts = flat(table.column("path"))
    known, of = np.unique(np.array([*names.to_pylist(), *(lead or [])], object), return_inverse=True) if len(names) or lead else (np.zeros(0, object), np.zeros(0, np.int64))
    lead_of, of = of[len(names) :], of[: len(names)]
    sizes = np.diff(starts)
    # how many first nodes each path has in common with the one before
    of_lead, first_path = lead_of, of[starts[0] : starts[1]]
    common = np.zeros(len(sizes), np.int64)
    both = np.minimum(sizes[1:], sizes[:-1])
    row = np.repeat(np.arange(len(both)), both)
    step = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    same = of[starts[1:-1][row] + step] == of[starts[:-2][row] + step]
    until = np.where(same, np.iinfo(np.int64).max, step)
    least = np.full(len(both), np.iinfo(np.int64).max)
    np.minimum.at(least, row, until)
    common[1:] = np.minimum(least, both)
    shared = 0
    while shared < min(len(of_lead), len(first_path)) and of_lead[shared] == first_path[shared]:
        shared += 1
    # the root is open all along; each path closes what it does not share and opens what is new
    turns = np.empty(2 * len(sizes) + 2, np.int64)
    turns[0], turns[1] = 0, 1
    turns[2::2] = np.r_[0, sizes[:-1] - common[1:]]
    turns[3::2] = sizes - common
    bits = np.r_[np.repeat(np.arange(len(turns)) % 2 == 1, turns), np.zeros(sizes[-1] + 1, bool)]
    tree = Parentheses(bits)
    opens = tree.opens()
    closes = tree.find_close(opens)
    new = np.arange(len(of)) - np.repeat(starts[:-1], sizes) >= np.repeat(common, sizes)
    place = np.flatnonzero(new)  # of each open but the root's, in the flat paths
    n, first, so_far = (flat(table.column(c))[0].to_numpy() for c in ("n", "first", "so_far"))
    leaf = flat(table.column("leaf"))[0].to_numpy(zero_copy_only=False)
    depth = place - np.repeat(starts[:-1], sizes)[place]
    counted = ~((place < sizes[0]) & (depth < shared))
    above = np.where(depth > 0, so_far[np.maximum(place - 1, 0)], 0)
    own = np.r_[0, np.where(counted, (n[place] - 1) * (so_far[place] - above), 0)]
    # a pair of an open and its close is a leaf of the tree, but for nodes counted before or going on in a later shard
    pairs = closes == opens + 1
    off = np.r_[0, np.cumsum(pairs & ~np.r_[False, counted & leaf[place].astype(bool)])]
    rank = np.r_[0, np.cumsum(bits)]
    leaves = tree.leaves_between(opens, closes) - (off[rank[closes]] - off[rank[opens]])
    saving = np.r_[0, np.cumsum(own)]
    saved = saving[rank[closes]] - saving[rank[opens] + 1]
    spine = np.r_[True, ~counted] | (closes >= len(bits) - sizes[-1] - 1)
    # who ends where: a path's end is its last node, and equal paths lie side by side
    node_of = np.zeros(len(known), np.int64)
    node_of[of[place]] = np.arange(1, len(opens))
    end = np.where(sizes > 0, node_of[of[np.maximum(starts[1:] - 1, 0)]] if len(of) else 0, 0)
    begin = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
    ends, n_ends = [None] * len(opens), np.zeros(len(opens), np.int64)
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(end)], strict=True):
        text, at = ",".join(map(str, ids[s:e])), int(end[s])
        ends[at] = text if spine[at] else hashlib.sha256(text.encode()).hexdigest()
        n_ends[at] = e - s
    nodes = [ROOT, *known[of[place]].tolist()]
    kinds = [f.split(" ")[0] for f in SHARD_FIELDS.split(", ")]
    return pa.Table.from_arrays([pa.array(nodes, pa.string()), *[pa.array(np.r_[0, x[place]].astype(np.int64)) for x in (n, first, so_far)], pa.array(leaves), pa.array(saved),
                                 pa.array(spine), pa.array(n_ends), pa.array(ends, pa.string()), pa.array(np.full(len(opens), shard, np.int64))], names=kinds)


def merge_spines(parts: DataFrame) -> DataFrame:
    """Nodes of several shards added up; the conv_ids that end there pass by in order, shard by shard."""
    fields = StructType.fromDDL("node string, n long, first long, so_far long, leaves long, saved long, ends string")

    def run(batches):
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["node"] != r["node"]:
                    if now is not None:
                        yield done(now)
                    now = {**r, "leaves": 0, "saved": 0, "sha": hashlib.sha256(), "any": False}
                now["leaves"] += r["leaves"]
                now["saved"] += r["saved"]
                if r["ends"]:
                    now["sha"].update((b"," if now["any"] else b"") + r["ends"].encode())
                    now["any"] = True
        if now is not None:
            yield done(now)

    def done(now):
        return pa.RecordBatch.from_pylist([{**{c: now[c] for c in fields.names[:-1]}, "ends": now["sha"].hexdigest()}], schema=arrow)

    arrow = pa.schema([("node", pa.string()), *[(c, pa.int64()) for c in ("n", "first", "so_far", "leaves", "saved")], ("ends", pa.string())])
    return parts.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(run, fields)


def prefix_trie(ids: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth from 1, t1, t2, size) of the conversations ``ids`` (conv_id), which may have none."""
    rows = scratch.keep(chained(scratch, turns))
    nodes = scratch.keep(nodes_of(rows))
    shards = in_shards(scratch, paths_of(ids, rows, nodes))
    parts = scratch.keep(shards.groupBy("shard").applyInArrow(encode_shard, StructType.fromDDL(SHARD_FIELDS)))
    whole = ["node", "n", "first", "so_far", "leaves", "saved", "ends"]
    inner = parts.filter("not spine").select(*whole[:-1], F.coalesce("ends", F.lit(NOTHING)).alias("ends"))
    tree = scratch.keep(inner.unionByName(merge_spines(parts.filter("spine"))))
    nothing = F.lit(NOTHING)
    # the root's figures, each from one row
    figures = ["conv_id", "n_convs", "n_children", "leaves", "saved", "ends"]
    parts = [ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")),
             nodes.filter(F.col("parent") == ROOT).agg(F.count(F.lit(1)).alias("n_children")),
             tree.filter(F.col("node") == ROOT).select("leaves", "saved", "ends")]
    root = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).agg(*[F.max(c).alias(c) for c in figures]).filter("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
                       F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    parents = nodes.select(F.col("node").alias("_node"), F.col("first").alias("_first")).unionByName(
        ids.agg(F.min("conv_id").alias("_first")).select(F.lit(ROOT).alias("_node"), "_first"))
    below = nodes.join(parents, F.col("parent") == F.col("_node")).drop("_node")
    shown = ["first", "depth", "_first", "n", "n_children"]
    # one member: a chain to that conversation's end
    alone = below.filter("n = 1").select(*shown, F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.when(
        F.col("n_children") == 0, F.sha2(F.col("first").cast("string"), 256)).otherwise(nothing).alias("ends"))
    # a chain's nodes have the members of its end, and its smallest member and their number are its alone
    ends = tree.filter(F.col("node") != ROOT).filter("n > 1").select(
        F.col("first").alias("_f"), F.col("n").alias("_n"), F.col("node").alias("_end"), F.col("so_far").alias("_far"), "leaves", "saved", "ends")
    chains = below.filter("n > 1").join(ends, (F.col("first") == F.col("_f")) & (F.col("n") == F.col("_n")))
    saved = F.col("saved") + (F.col("n") - 1) * (F.col("_far") - F.col("so_far") + F.col("size"))
    many = chains.select(*shown, "leaves", saved.alias("saved"), F.when(F.col("node") == F.col("_end"), F.col("ends")).otherwise(nothing).alias("ends"))
    return root.union(alone.union(many))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text): a row for each node."""
    with Scratch(turns.sparkSession) as scratch:
        ids, rows = rebuilt(scratch, turns)
        return scratch.result(prefix_trie(ids, rows, scratch))


#: The same rows in DuckDB's SQL: a node is the list of its turns.
SQL = """
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as d
  from conversations where conv_id is not null),
hex as (
  select range as byte, list_reduce(list_prepend(range, range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as entry from range(256)),
crc_table as (select list(entry order by byte) as entries from hex),
ids as (
  select conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda x, b: xor(x >> 8, entries[(xor(x, b) & 255) + 1])), 4294967295) % 6 as h, conv_id - conv_id % 100 as base
  from (select distinct conv_id from own), crc_table),
counts as (select conv_id, count(*) as n from own group by conv_id),
taken as (select i.conv_id, base, h, least(h, coalesce(c.n, 0)) as p from ids i left join counts c on c.conv_id = i.base),
turns as (
  select t.conv_id, o.d, o.role, o.text from taken t join own o on o.conv_id = t.base and o.d <= t.p
  union all select t.conv_id, o.d - t.h + t.p, o.role, o.text from taken t join own o on o.conv_id = t.conv_id and o.d > t.h),
whole as (select i.conv_id, coalesce(list({'role': role, 'text': text} order by d) filter (d is not null), []) as path
  from ids i left join turns t on t.conv_id = i.conv_id group by i.conv_id),
places as (select conv_id, path, len(path) as depth, unnest(range(len(path) + 1)) as d from whole),
members as (select conv_id, path[1:d] as node, d, depth, case when d = 0 then 0 else length(path[d].text) end as size from places),
nodes as (
  select node, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = d), '')) as ends_sha256
  from members group by node),
linked as (
  select c.node, c.depth, c.conv_id, p.conv_id as parent_conv_id, c.n_convs, c.ends_sha256, (c.n_convs - 1) * c.size as own,
    (select count(*) from nodes k where k.depth = c.depth + 1 and k.node[1:c.depth] = c.node) as n_children
  from nodes c left join nodes p on p.depth = c.depth - 1 and p.node = c.node[1:c.depth - 1]),
below as (
  select a.node, count(*) filter (b.n_children = 0) as n_leaves, sum(b.own)::bigint as saved_tokens
  from (select *, unnest(range(depth + 1)) as up from linked) b join linked a on a.depth = b.up and a.node = b.node[1:b.up] group by a.node)
select l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, b.n_leaves, b.saved_tokens, l.ends_sha256
from linked l join below b on b.node = l.node
"""
