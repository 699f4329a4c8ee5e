"""Packing tokenized documents into sequences of a fixed capacity.

``tokenize`` turns each whole text into ids by a vocabulary file and ends it with ``end``; a
document longer than the capacity is cut into pieces of that size, the last one shorter.
``pack`` gives pieces of known lengths a sequence and an offset, by the pattern packing of
``patterns``. ``sequences`` puts the ids of each sequence together.

Only the histogram of lengths goes to the driver: a number for each length up to the capacity.
The plan that comes back has a line for each run of pieces of one length that goes to a run of
sequences. A sequence range holds at most sqrt(2 capacity) different lengths, and each length
opens two ranges at most, so lines are bounded by the capacity too (12,000 for a million documents
of 4,096 lengths). Pieces of one length are numbered through by counts for each task, so
that no length, however common, is gathered in one task.

Null text: empty, the one id ``end``. Repeated rows are documents of their own. An empty table
gives no pieces. Columns of the input named like a new one are replaced.
"""

from __future__ import annotations

import functools
import json
import os
import random
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm.bpe import ByteBPE, byte_symbols
from tablewright.llm.common import fresh, gather, text_buffers, text_slices
from tablewright.llm.patterns import plan
from tablewright.llm.scratch import Scratch

CAPACITY = 4096
#: The plan's size follows the capacity, so that is bounded.
MOST_CAPACITY = 1 << 16
#: Distinct words a task remembers before it starts anew.
WORDS_KEPT = 300_000
#: Characters below this one are tried, those of one byte and of two bytes from C2 to C9; what a character is: white space, part of a word of its kind, or left to the library.
LATIN = 0x280
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
#: Slots of the table of merges, and the odd number that spreads keys over them.
SLOT_BITS = 19
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Words by which the batched merges are held against the library.
PROBE = ["a", "ab", "aaaaaaa", "straße", "être", "niño", "unbelievably", "zzzqqq", "thething", "ŵƿ"]


class EndedWords(ByteBPE):
    """A vocabulary whose words end in a mark: the last byte of a word is a symbol of its own."""

    def __init__(self, path: str, mark: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        self.last = np.array([vocab[c + mark] for c, _ in sorted(byte_symbols().items(), key=lambda x: x[1])], np.int64)
        # one slot of a table holds most keys alone; those that share one are searched for
        slot = self.slot(self.keys)
        self.slots = np.zeros(1 << SLOT_BITS, np.int64)
        self.slots[slot] = np.arange(len(self.keys))
        self.shared = np.bincount(slot, minlength=1 << SLOT_BITS) > 1

    def slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * SPREAD) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def places(self, pair: np.ndarray) -> np.ndarray:
        slot = self.slot(pair)
        at = self.slots[slot]
        search = np.flatnonzero(self.shared[slot])
        at[search] = super().places(pair[search])
        return at

    def symbols(self, raw: bytes, sizes: np.ndarray) -> np.ndarray:
        ids = super().symbols(raw, sizes)
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[np.frombuffer(raw, np.uint8)[ends]]
        return ids


class WordIds:
    """Ids as the tokenizers library gives them, each distinct word of a task encoded once.

    Where the vocabulary drops white space a text is cut at spaces and line breaks; else a word is
    the whole text. What stands between is cut into letters, single digits and other signs
    and merged in batches if it has only such characters (below U+0280) as are found to give the
    library's ids that way; the library sees the others whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        added = self.tool.get_added_tokens_decoder().values()
        parts = self.ids_of(["Ab'a", ".", "1"])
        self.cuts = self.ids_of(["Ab'a. 1"])[0] == [*chain(*parts)] and not any(t.lstrip or t.rstrip or " " in t.content or "\n" in t.content for t in added)
        with open(path, encoding="utf-8") as file:
            mark = json.load(file)["model"].get("end_of_word_suffix")
        self.merges = EndedWords(path, mark) if mark and self.cuts else None
        if self.merges and not np.array_equal(self.merges.merge(PROBE)[0], [*chain(*self.ids_of(PROBE))]):
            self.merges = None
        # by code point: the kind, and the character in lower case
        self.kinds, self.lower = np.full(LATIN, ODD, np.uint8), np.arange(LATIN)
        if self.merges:
            self.try_characters("'" + "".join(t.content[:1] for t in added))
        self.kinds[[ord(" "), ord("\n")]] = SPACE
        # bytes from 128 on are parts of characters
        self.byte_kinds, self.byte_lower = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
        self.byte_kinds[:128], self.byte_lower[:128] = self.kinds[:128], self.lower[:128]
        self.forget()
        # kinds side by side, as the library cuts them; else it sees all words
        plain, rnd = [chr(c) for c in np.flatnonzero(self.kinds != ODD)], random.Random(0)
        mixed = ["".join(rnd.choices(plain, k=40)) for _ in range(200)]
        flat, _ = self.encode(pa.array(mixed), -1)
        if flat[flat >= 0].tolist() != [*chain(*self.ids_of(mixed))]:
            self.byte_kinds[self.byte_kinds != SPACE] = self.kinds[self.kinds != SPACE] = ODD
        self.forget()

    def try_characters(self, odd: str) -> None:
        """Note the kind of each character whose ids, between two letters, are the library's."""
        tried = []
        for c in map(chr, range(LATIN)):
            low = c.lower()
            if c in odd or len(low) > 1 or low >= chr(LATIN):
                continue
            if c.isalpha():
                tried.append((c, low, LETTER, [f"x{low}{low}y"]))
            elif c.isascii() and c.isdigit():
                tried.append((c, low, DIGIT, ["x", c, c, "y"]))
            elif c.isascii() and c.isprintable() and c != " ":
                tried.append((c, low, SIGN, ["x", c + c, "y"]))
        for (c, low, kind, words), ids in zip(tried, self.ids_of([f"x{c}{c}y" for c, *_ in tried]), strict=True):
            if self.merges.merge(words)[0].tolist() == ids:
                self.kinds[ord(c)], self.lower[ord(c)] = kind, ord(low)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each word begins and ends, whether the library must see it, and the bytes, in lower case but for such words."""
        if not self.cuts:
            full = np.flatnonzero(np.diff(rows))
            return rows[full], rows[full + 1], np.ones(len(full), bool), data
        kind, low = self.byte_kinds[data], self.byte_lower[data]
        lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xC9) & (data[1:] >> 6 == 2))
        point = ((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)
        kind[lead] = kind[lead + 1] = self.kinds[point]
        point = self.lower[point]
        low[lead], low[lead + 1] = 0xC0 | point >> 6, 0x80 | point & 63
        first = np.zeros(len(data) + 1, bool)
        first[rows] = True
        first = first[:-1]
        inside = kind != SPACE
        begin = np.flatnonzero(inside & (first | ~np.r_[False, inside[:-1]]))
        if len(begin):
            odd = np.repeat(np.maximum.reduceat(kind, begin) == ODD, np.diff(np.r_[begin, len(data)]))
            at = begin[0] + np.flatnonzero(odd & inside[begin[0] :])
            kind[at], low[at] = ODD, data[at]
        bounds = np.flatnonzero(first | np.r_[True, kind[1:] != kind[:-1]][: len(kind)] | (kind == DIGIT))
        ends = np.r_[bounds[1:], len(data)]
        kept = inside[bounds]
        bounds = bounds[kept]
        return bounds, ends[kept], kind[bounds] == ODD, low

    def learn(self, words: list[bytes], odd: list[bool]) -> None:
        plain = [w for w, o in zip(words, odd, strict=True) if not o]
        rest = [w for w, o in zip(words, odd, strict=True) if o]
        flat, sizes = [], []
        if plain:
            ids, many = self.merges.merge_bytes(b"".join(plain), np.fromiter(map(len, plain), np.int64, len(plain)))
            flat.append(ids)
            sizes.append(many)
        if rest:
            ids = self.ids_of([w.decode() for w in rest])
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain(*ids), np.int64, int(sizes[-1].sum())))
        ids, many = np.concatenate(flat), np.concatenate(sizes)
        self.index.update(zip(plain + rest, range(len(self.sizes), len(self.sizes) + len(many)), strict=True))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(many) - many]
        self.flat, self.sizes = np.r_[self.flat, ids], np.r_[self.sizes, many]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, ``end`` behind each, and the row offsets."""
        if len(self.index) > WORDS_KEPT:
            self.forget()
        data, rows = text_buffers(texts)
        starts, ends, odd, low = self.words(data, rows)
        one, of = distinct_runs(low, starts, ends - starts)
        raw = low.tobytes()
        words = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        new = {w: o for w, o in zip(words, odd[one].tolist(), strict=True) if w not in self.index}
        if new:
            self.learn(list(new), list(new.values()))
        word = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[of]
        sizes = self.sizes[word]
        flat = gather(self.flat, self.starts[word], sizes)
        offsets = np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, rows)]
        return np.insert(flat, offsets[1:], end), offsets + np.arange(len(offsets))


def distinct_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One run of bytes for all that are equal, and for each run the number of that one; runs over 16 bytes stand for themselves."""
    padded = np.r_[data, np.zeros(16, np.uint8)]
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    short = np.flatnonzero(sizes <= 16)
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    head = eight[starts[short]] & mask[np.minimum(sizes[short], 8)]
    tail = eight[starts[short] + 8 * (sizes[short] > 8)] & mask[np.maximum(sizes[short] - 8, 0)]
    mixed, group = np.unique(head ^ (tail * SPREAD), return_inverse=True)
    one = np.empty(len(mixed), np.int64)
    one[group] = np.arange(len(short))
    same = one[group]
    if not (np.array_equal(head[same], head) and np.array_equal(tail[same], tail) and np.array_equal(sizes[short][same], sizes[short])):
        one = group = np.arange(len(short))  # two runs came to one number
    long = np.flatnonzero(sizes > 16)
    of = np.empty(len(starts), np.int64)
    of[short], of[long] = group, len(one) + np.arange(len(long))
    return np.r_[short[one], long], of


@functools.lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 1, text: str = "text",
             keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """The pieces of each document: the columns of ``docs`` (``keep``: only these), piece, start, length, ids_crc32 and, unless not wanted, ids."""
    extra = StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else ""))
    new = {f.name for f in extra}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    source = docs.select(*dict.fromkeys([*kept, text]))
    schema = StructType([source.schema[c] for c in kept] + list(extra))

    def run(batches):
        tool = word_ids(path)
        for batch in batches:
            for part in text_slices(batch, text):
                flat, offsets = tool.encode(part.column(text), end)
                sizes = np.diff(offsets)
                many = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = offsets[row] + start
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                out = [part.column(c).take(pa.array(row)) for c in kept]
                out += [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[begin, len(flat)], pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return source.mapInArrow(run, schema)


def numbered(df: DataFrame, length: str, part: str, rank: str) -> DataFrame:
    """``df`` with the task that a row was in and its number among the rows of its length there."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            first = np.searchsorted(ordered, ordered)
            place = np.empty(len(size), np.int64)
            place[order] = np.arange(len(size)) - first
            if len(size) and ordered[-1] >= len(seen):
                seen = np.r_[seen, np.zeros(ordered[-1] + 1 - len(seen), np.int64)]
            place += seen[size]
            np.add.at(seen, size, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), task, np.int64)), pa.array(place)], names=[*batch.schema.names, part, rank])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{part}` long, `{rank}` long")]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id (from 0) and offset, as few sequences as the packing finds.

    Every length must be from 1 to ``capacity``; a null or other one is an error.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity {capacity} is not from 1 to {MOST_CAPACITY}")
    scratch = Scratch(pieces.sparkSession)
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    part, rank, base = (fresh(pieces, name) for name in ("pack_part", "pack_rank", "pack_base"))
    fits = F.when(F.col(length).between(1, capacity), F.col(length)).otherwise(
        F.raise_error(F.concat(F.lit(f"length not from 1 to {capacity}: "), F.coalesce(F.col(length).cast("string"), F.lit("null"))))).cast("long")
    sized = pieces.select(*[fits.alias(c) if c == length else c for c in kept])
    # written once: the numbers stay what they are, and nothing before is done twice
    rows = scratch.result(numbered(sized, length, part, rank))
    counts = rows.groupBy(length, part).agg(F.count(F.lit(1)).alias("n"))
    tally = np.zeros(capacity + 1, np.int64)
    for size, n in counts.groupBy(length).agg(F.sum("n")).collect():  # a row for each length
        tally[size] = n
    lines, _ = plan(tally, capacity)
    key = (lines["length"] << 48) + lines["start"]
    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(length).alias("_l"), F.col(part).alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    placed = rows.join(bases, (F.col(length) == F.col("_l")) & (F.col(part) == F.col("_p"))).drop("_l", "_p")
    schema = StructType([rows.schema[c] for c in kept] + list(StructType.fromDDL("sequence_id long, offset long")))

    def run(batches):
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            k = batch.column(rank).to_numpy() + batch.column(base).to_numpy()
            line = np.searchsorted(key, (size << 48) + k, side="right") - 1
            k = k - lines["start"][line]
            n = lines["n"][line]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(lines["sequence"][line] + k % n),
                                              pa.array(lines["offset"][line] + k // n * size)], names=schema.names)

    return placed.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, the ids of its pieces one after the other, and where each piece begins."""
    each = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    return each.select("sequence_id", F.flatten("all.ids").alias("ids"), F.col("all.offset").alias("starts"))
