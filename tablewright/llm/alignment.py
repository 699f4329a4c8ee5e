"""Aligning the tokens of two vocabularies over the same text.

A text with a space before it is encoded by a byte-level vocabulary (A) and a piece vocabulary
(B). Tokens stand for bytes, so each side is an incidence matrix of tokens and bytes in
compressed rows. A·Bᵀ, row by row, has an entry for each pair of tokens that overlap: the links.
Where tokens of both sides end together the text is cut into groups; the product of the
incidence matrices of tokens and groups has the pairs that share a group.

Hardly a token runs from a non-space into white space, so a text is
cut before each run of white space, and each distinct word of a block of texts is encoded and
multiplied once. (Tokens that run into a carriage return do exist: a text with white space of that kind is one word.)

How often two ids are linked in the whole corpus is counted in two passes. The first writes for each
block of texts its documents, as numbers of words, and the pairs of ids linked in it with their
counts. Pairs are added up over blocks; the sums go back to the blocks that hold the pair,
and each block adds them up for its documents. What is shuffled is a line for each distinct pair of a
block and a number for each word, no links one by one. A block has ``BLOCK_BYTES`` of text, a longer text alone.

Null and empty texts, and texts whose tokens do not give their bytes back (as one with U+2581), have no
tokens: zeros, and an empty ``groups_sha256``. Repeated rows are rows of their own. Columns of the
input named like a new one are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm.bpe import byte_symbols
from tablewright.llm.common import fresh, gather, text_slices
from tablewright.llm.scratch import Scratch
from tablewright.llm.sparse import Rows, incidence, product, reach

BLOCK_BYTES = 6 << 20
# White space of the byte-level pattern, which the control characters 1C to 1F are not.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")
SPACE = re.compile(r"[^\S\x1c-\x1f]")
#: White space that a token runs into, from a non-space or from the space put first.
CROSSES = re.compile(r"(?<=[^\s▁])[\s▁]|(?<=^▁)[^\S ]")
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Rows:
    """Tokens of A by tokens of B over the same bytes: how many bytes both hold."""
    starts = np.r_[0, np.cumsum(a_sizes)], np.r_[0, np.cumsum(b_sizes)]
    many = int(starts[0][-1])
    a, b = (incidence(s, np.arange(many), many) for s in starts)
    return product(a, b.transpose())


def groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[Rows, Rows]:
    """Tokens of A and tokens of B by the groups between common ends."""
    ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    cuts = np.intersect1d(*ends)
    return tuple(incidence(np.arange(len(e) + 1), np.searchsorted(cuts, e), len(cuts)) for e in ends)


class Vocabularies:
    """Both vocabularies, with the bytes of each token."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte = Tokenizer.from_file(byte_path)
        self.byte.no_truncation()
        self.byte.no_padding()
        self.byte.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        symbols = byte_symbols()
        with open(byte_path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        self.a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a[i] = bytes(symbols.get(c, 63) for c in token)
        self.b, crossed = [], set()
        for i in range(self.piece.get_piece_size()):
            token = self.piece.id_to_piece(i)
            if not (self.piece.is_control(i) or self.piece.is_unknown(i)):
                crossed.update(CROSSES.findall(token))
            self.b.append(bytes([int(token[3:5], 16)]) if self.piece.is_byte(i) else token.replace("▁", " ").encode())
        self.space = self.piece.piece_to_id("▁")
        self.cuts = "▁" not in crossed
        self.crossed = re.compile(f"[{re.escape(''.join(sorted(crossed)))}]") if crossed else None
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)], np.int64) for x in (self.a, self.b))
        self.a_text, self.b_text = ([*map(str, range(len(x)))] for x in (self.a, self.b))
        ends = [[t + e for t in texts] for texts, e in ((self.a_text, ","), (self.a_text, "|"), (self.b_text, ","), (self.b_text, ";"))]
        self.parts = np.array([*chain(*ends)], object)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.byte.encode_batch_fast(chunks, add_special_tokens=False)]
        # B puts a space before what it gets: it gets the chunk without its own, or loses the one it put there
        b = self.piece.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return a, [[self.space] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, b, strict=True)]

    def same(self, chunk: str, a: list[int], b: list[int]) -> bool:
        raw = chunk.encode()
        return b"".join(map(self.a.__getitem__, a)) == raw and b"".join(map(self.b.__getitem__, b)) == raw


@functools.lru_cache(2)
def vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    return Vocabularies(byte_path, piece_path)


class Block:
    """The distinct words of a run of texts, what they align to, and how often each stands there."""

    def __init__(self, tools: Vocabularies):
        self.tools, self.index, self.bytes = tools, {}, 0
        self.odd, self.bad = np.zeros(0, bool), np.zeros(0, bool)
        self.counts = np.zeros((0, len(COUNTS)), np.int64)
        self.lines: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.seen = np.zeros(0, np.int64)

    def chunk(self, word: str) -> str | None:
        """The piece of text that a word stands for; None where simple cuts do not do."""
        if word[:1] == "\0" and SPACE.match(word[1:2]):
            return word[1:]
        rest = word[1:] if word[:1] == "\n" else word
        return None if not rest or SPACE.search(rest) else word if word[0] == "\n" else " " + word

    def split(self, text: str) -> list[str]:
        """A text with uncommon white space, cut before each run of it."""
        if not self.tools.cuts or self.tools.crossed and self.tools.crossed.search(text):
            return ["\0 " + text]
        found = CHUNK.findall(" " + text)
        return [c[1:] if c[0] == " " and len(c) > 1 and not SPACE.match(c[1]) else c if c[0] == "\n" and len(c) > 1 and not SPACE.match(c[1]) else "\0" + c for c in found]

    def learn(self, words: list[str]) -> None:
        tools = self.tools
        chunks = [self.chunk(w) for w in words]
        known = [c or "" for c in chunks if c is not None]
        a, b = tools.encode(known)
        fits = [tools.same(c, x, y) for c, x, y in zip(known, a, b, strict=True)]
        a, b = ([x if f else [] for x, f in zip(ids, fits, strict=True)] for ids in (a, b))
        na, nb = (np.array([*map(len, x)], np.int64) for x in (a, b))
        a, b = (np.fromiter(chain(*x), np.int64) for x in (a, b))
        sizes = tools.a_sizes[a], tools.b_sizes[b]
        links = overlaps(*sizes)
        left = np.repeat(np.arange(len(a)), np.diff(links.starts))
        of_a, of_b = np.repeat(np.arange(len(known)), na), np.repeat(np.arange(len(known)), nb)
        n_links = np.bincount(of_a[left], minlength=len(known))
        pairs = (a[left] << 32) + b[links.columns]
        in_a, in_b = groups(*sizes)
        shared = np.bincount(of_a, weights=reach(in_a, in_b.transpose()), minlength=len(known)).astype(np.int64)
        lasts = [np.r_[x.columns[1:] != x.columns[:-1], True] if len(x.columns) else np.zeros(0, bool) for x in (in_a, in_b)]
        n_groups = np.bincount(of_a[lasts[0]], minlength=len(known))
        one, two = len(tools.a), len(tools.b)
        part = np.r_[a + lasts[0] * one, 2 * one + b + lasts[1] * two]
        order = np.argsort(np.r_[2 * in_a.columns, 2 * in_b.columns + 1], kind="stable")
        parts = tools.parts[part[order]].tolist()
        ends = np.cumsum(na + nb).tolist()
        lines = ["".join(parts[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
        counts = np.stack([na, nb, n_groups, n_links, shared], 1) if known else np.zeros((0, len(COUNTS)), np.int64)
        # words that simple cuts do not do for hold their place with nothing
        at = np.flatnonzero([c is not None for c in chunks])
        all_counts, all_lines, all_bad = np.zeros((len(words), len(COUNTS)), np.int64), [""] * len(words), np.zeros(len(words), bool)
        all_counts[at], all_bad[at] = counts, ~np.array(fits, bool)
        for k, line in zip(at.tolist(), lines, strict=True):
            all_lines[k] = line
        odd = np.ones(len(words), bool)
        odd[at] = False
        self.index.update(zip(words, range(len(self.lines), len(self.lines) + len(words)), strict=True))
        self.odd, self.bad, self.counts = np.r_[self.odd, odd], np.r_[self.bad, all_bad], np.r_[self.counts, all_counts]
        self.lines += all_lines
        self.pairs.append(pairs)

    def numbers(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.index))
        if new:
            self.learn(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def add(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
        """Each text's words by number, its counts, and its groups as text; nothing for a text that does not fit."""
        each = [(t.replace("\n", " \n").split(" ") if self.tools.cuts and "\0" not in t else self.split(t)) if t else [] for t in texts]
        ends = np.cumsum([len(ws) for ws in each], dtype=np.int64).tolist()
        flat = self.numbers([*chain(*each)])
        rows = [flat[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        odd = [k for k, row in enumerate(rows) if self.odd[row].any()]
        for k in odd:
            rows[k] = self.numbers(self.split(texts[k]))
        rows = [row[:0] if self.bad[row].any() else row for row in rows]
        flat = np.concatenate(rows) if rows else flat
        if len(self.seen) < len(self.lines):
            self.seen = np.r_[self.seen, np.zeros(len(self.lines) - len(self.seen), np.int64)]
        self.seen += np.bincount(flat, minlength=len(self.seen))
        counts = np.stack([self.counts[row].sum(0) for row in rows]) if rows else np.zeros((0, len(COUNTS)), np.int64)
        lines = ["".join(map(self.lines.__getitem__, row.tolist()))[:-1] for row in rows]
        return rows, counts, lines

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of linked ids and how often each is linked; for each word its links, as places among the pairs, and where they start."""
        flat = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        pairs = np.sort(flat)
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        links = np.searchsorted(pairs, flat)
        sizes = self.counts[:, COUNTS.index("n_links")]
        word = np.repeat(np.arange(len(sizes)), sizes)
        times = np.bincount(links, weights=self.seen[word], minlength=len(pairs)).astype(np.int64)
        return pairs, times, links, np.r_[0, np.cumsum(sizes)]


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], kind)).cast(pa.list_(kind))


DOC_FIELDS = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string, groups_sha256 string"


def first_pass(docs: DataFrame, byte_path: str, piece_path: str, text: str, kept: list[str], with_groups: bool, own: dict[str, str]) -> DataFrame:
    """A row for each document with its words, and a row for each block with its pairs and the links of its words."""
    extra = StructType.fromDDL(f"{DOC_FIELDS}, `{own['block']}` long, `{own['words']}` array<int>, `{own['links']}` array<int>, "
                               f"`{own['starts']}` array<int>, `{own['pairs']}` array<long>, `{own['times']}` array<long>")
    source = docs.select(*dict.fromkeys([*kept, text]))
    schema = StructType([source.schema[c] for c in kept] + list(extra))

    def run(batches):
        tools, task, at = vocabularies(byte_path, piece_path), TaskContext.get().partitionId(), 0
        block = Block(tools)

        def close(like: pa.RecordBatch) -> pa.RecordBatch:
            pairs, times, links, starts = block.pair_counts()
            nothing = [pa.nulls(1, like.column(i).type) for i in range(len(like.columns) - 6)]
            return pa.RecordBatch.from_arrays([*nothing, pa.array([(task << 28) + at], pa.int64()), pa.nulls(1, pa.list_(pa.int32())),
                                               lists([links], pa.int32()), lists([starts], pa.int32()), lists([pairs], pa.int64()), lists([times], pa.int64())],
                                              names=schema.names)

        out = None
        for batch in batches:
            for part in text_slices(batch, text):
                texts = part.column(text).fill_null("").to_pylist()
                if block.bytes and block.bytes + sum(map(len, texts)) > BLOCK_BYTES:
                    yield close(out)
                    block, at = Block(tools), at + 1
                rows, counts, found = block.add(texts)
                block.bytes += sum(map(len, texts))
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found]
                n = len(texts)
                out = pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(counts[:, k]) for k in range(len(COUNTS))],
                                                  pa.array(found, pa.string()) if with_groups else pa.nulls(n, pa.string()), pa.array(sha, pa.string()),
                                                  pa.array(np.full(n, (task << 28) + at, np.int64)), lists(rows, pa.int32()),
                                                  *[pa.nulls(n, pa.list_(pa.int32()))] * 2, *[pa.nulls(n, pa.list_(pa.int64()))] * 2], names=schema.names)
                yield out
        if out is not None:
            yield close(out)

    return source.mapInArrow(run, schema)


def totals(lines: DataFrame) -> DataFrame:
    """``pair`` and ``times`` of blocks, added up: pair, n, and whether no other pair of its B id has more.

    A B id has at most as many pairs as A has ids, so a window over it is bounded.
    """
    whole = lines.groupBy("pair").agg(F.sum("times").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    return whole.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None, with_groups: bool = True) -> DataFrame:
    """``docs`` without their texts (``keep``: only these columns) and, for each text, its tokens, groups and links.

    n_a, n_b, n_groups, n_links; n_shared: pairs of tokens in one group; n_best: links whose pair of ids is
    linked as often as any of its B id; count_sum: how often the pairs of its links are linked in the
    corpus; groups, as ids of A and B; groups_sha256.
    """
    new = {f.name for f in StructType.fromDDL(DOC_FIELDS)} | {"n_best", "count_sum"}
    kept = [c for c in ([c for c in docs.columns if c != text] if keep is None else keep) if c.lower() not in new]
    own = {name: fresh(docs, f"align_{name}") for name in ("block", "words", "links", "starts", "pairs", "times")}
    rows = Scratch(docs.sparkSession).result(first_pass(docs, byte_path, piece_path, text, kept, with_groups, own))
    found = rows.filter(F.col(own["pairs"]).isNotNull()).select(
        F.col(own["block"]).alias("block"), F.posexplode(F.arrays_zip(F.col(own["pairs"]).alias("pair"), F.col(own["times"]).alias("times"))))
    found = found.select("block", F.col("pos").alias("place"), "col.pair", "col.times")
    known = found.drop("times").join(totals(found), "pair").select("block", "place", "n", "best")
    left = rows.drop(own["pairs"], own["times"])
    shown = [f.name for f in StructType.fromDDL(DOC_FIELDS) if with_groups or f.name != "groups"]
    schema = StructType([*[left.schema[c] for c in [*kept, *shown]], *StructType.fromDDL("n_best long, count_sum long")])
    block, words, links, starts = (own[c] for c in ("block", "words", "links", "starts"))

    def add_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        whole = docs.column(links).is_valid()
        book, docs = docs.filter(whole), docs.filter(docs.column(words).is_valid())
        place = pairs.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place] = pairs.column("n").to_numpy()
        best[place] = pairs.column("best").to_numpy(zero_copy_only=False)
        link = book.column(links).combine_chunks().flatten().to_numpy()
        start = book.column(starts).combine_chunks().flatten().to_numpy()
        sums = []
        for each in (best, n):
            run = np.r_[0, np.cumsum(each[link])]
            of_word = run[start[1:]] - run[start[:-1]]
            column = docs.column(words).combine_chunks()
            run = np.r_[0, np.cumsum(of_word[column.flatten().to_numpy()])]
            ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy().astype(np.int64))]
            sums.append(pa.array(run[ends[1:]] - run[ends[:-1]]))
        return pa.Table.from_arrays([*[docs.column(c) for c in [*kept, *shown]], *sums], names=schema.names)

    return left.groupBy(block).cogroup(known.groupBy("block")).applyInArrow(add_up, schema)


def linked_pairs(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """The pairs of ids linked anywhere: a_id, b_id, n (links in the corpus) and whether it is a best one of its b_id."""
    own = {name: f"align_{name}" for name in ("block", "words", "links", "starts", "pairs", "times")}
    rows = first_pass(docs, byte_path, piece_path, text, [], False, own)
    lines = rows.filter(F.col(own["pairs"]).isNotNull()).select(F.inline(F.arrays_zip(F.col(own["pairs"]).alias("pair"), F.col(own["times"]).alias("times"))))
    split = totals(lines).filter("n > 0")
    return split.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), "n", "best")
