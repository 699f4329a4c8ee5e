"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all neighbouring pairs by
binary search over the sorted pair keys, finds the lowest rank of each word and merges all
places of that pair; words without a known pair leave the array. Each distinct word of a task
is merged once.

Null text: empty, no ids, decoded to the empty text. Repeated rows get equal results. A text
is never cut; a word of any length is merged whole. The special token written out in a text
becomes its one id, as the library does by default. Columns of the input named like a new one are replaced.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tablewright.llm.common import add_columns, gather

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words a task remembers before it starts anew.
WORDS_KEPT = 100_000
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The vocabulary file writes each byte as one printable character."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level vocabulary as flat tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        vocab, added = spec["model"]["vocab"], spec.get("added_tokens", [])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.first = np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int64)
        self.special = {t["content"]: t["id"] for t in added}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_sizes = np.array([len(p) for p in pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index = {token: k for k, token in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), np.int64)
        self.sizes = np.ones(len(self.special), np.int64)
        self.starts = np.arange(len(self.special), dtype=np.int64)

    def words(self, text: str) -> list[str]:
        if not self.special or not any(token in text for token in self.special):
            return self.find(text)
        out, at = [], 0
        for hit in self.split.finditer(text):
            out += [*self.find(text[at : hit.start()]), hit.group()]
            at = hit.end()
        return out + self.find(text[at:])

    def symbols(self, raw: bytes, sizes: np.ndarray) -> np.ndarray:
        """The symbol that each byte of the words begins with."""
        return self.first[np.frombuffer(raw, np.uint8)]

    def places(self, pair: np.ndarray) -> np.ndarray:
        """Where each pair is among the keys, if it is there at all."""
        return np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each word has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        return self.merge_bytes(b"".join(raw), np.array([len(r) for r in raw], np.int64))

    def merge_bytes(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, of words that lie one after the other in UTF-8."""
        ids = self.symbols(raw, sizes)
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            pair = np.r_[ids[:-1] * self.size + ids[1:], -1]
            at = self.places(pair)
            known = (self.keys[at] == pair) & np.r_[word[1:] == word[:-1], False]
            rank = np.where(known, self.ranks[at], NO_RANK)
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            ended = lowest == NO_RANK
            done_ids.append(ids[ended])
            done_words.append(word[ended])
            here = np.flatnonzero((rank == lowest) & ~ended)
            run = np.r_[True, here[1:] != here[:-1] + 1] if len(here) else np.zeros(0, bool)
            begin = here[run][np.cumsum(run) - 1] if len(here) else here
            here = here[(here - begin) % 2 == 0]  # in a run of one letter every second pair
            ids[here] = self.merged[at[here]]
            stay = ~ended
            stay[here + 1] = False
            ids, word = ids[stay], word[stay]
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return (np.concatenate(done_ids)[order] if done_ids else ids), np.bincount(word, minlength=len(sizes))

    def learn(self, words: list[str]) -> None:
        flat, sizes = self.merge(words)
        self.index.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.flat, self.sizes = np.r_[self.flat, flat], np.r_[self.sizes, sizes]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the row offsets."""
        if len(self.index) > WORDS_KEPT:
            self.forget()
        each = [self.words(t) for t in texts]
        words = [w for ws in each for w in ws]
        new = list(set(words).difference(self.index))
        if new:
            self.learn(new)
        row = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[row]
        ends = np.r_[0, np.cumsum(sizes)]
        offsets = ends[np.r_[0, np.cumsum([len(ws) for ws in each], dtype=np.int64)]]
        return gather(self.flat, self.starts[row], sizes), offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row of ids; bytes that are no UTF-8 become the replacement character."""
        sizes = self.piece_sizes[ids]
        raw = gather(self.piece_bytes, self.piece_starts[ids], sizes).tobytes()
        cuts = np.r_[0, np.cumsum(sizes)][offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` and the token ids of each whole text, as the vocabulary file at ``path`` makes them.

    With ``decoded`` the ids are decoded again in the same pass, into a column of that name.
    """

    def factory():
        bpe = vocabulary(path)

        def scan(column):
            flat, offsets = bpe.encode(column.fill_null("").to_pylist())
            out = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
            return out + [pa.array(bpe.decode(flat, offsets), pa.string())] if decoded else out

        return scan

    return add_columns(df, text, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""), factory)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` and the text that each row's ids stand for; null ids give the empty text."""
    keep = [c for c in df.columns if c.lower() != decoded.lower()]
    source = df.select(*keep)

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            column = batch.column(ids)
            lists = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32())) if column.null_count else column
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = bpe.decode(flat.astype(np.int64), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, decoded])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(decoded, StringType())]))
