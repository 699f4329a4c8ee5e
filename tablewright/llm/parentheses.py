"""Trees as balanced parentheses: a bit for each open and close, in depth-first order."""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    """Answers for all opening places at once.

    Excess is the number of opens less closes so far. Its lowest value is kept for each block
    of ``BLOCK`` bits and, over the blocks, in a tree of minima. The close of an open place is the
    first later place whose excess is lower than the open's: it lies in the same block, or in the
    first later block whose minimum is low enough, which is found up and down the tree.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        steps = np.where(self.bits, 1, -1).astype(np.int64)
        self.excess = np.cumsum(steps)
        self.blocks = max(1, 1 << int(np.ceil(np.log2(max(1, -(-len(bits) // BLOCK))))))
        padded = np.full(self.blocks * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.padded = padded.reshape(self.blocks, BLOCK)
        tree = np.empty(2 * self.blocks, np.int64)
        tree[self.blocks :] = self.padded.min(axis=1)
        level = self.blocks
        while level > 1:
            half = level // 2
            tree[half:level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level = half
        self.tree = tree
        pairs = np.r_[self.bits[:-1] & ~self.bits[1:], False] if len(bits) else np.zeros(0, bool)
        self.leaves = np.r_[0, np.cumsum(pairs)]

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def first_below(self, block: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """In each given block the first place from ``start`` on with excess under ``bound``; -1 if there is none."""
        out = np.full(len(block), -1, np.int64)
        many = 1 << 14
        for at in range(0, len(block), many):
            part = slice(at, at + many)
            hit = (self.padded[block[part]] < bound[part, None]) & (np.arange(BLOCK) >= start[part, None])
            out[part] = np.where(hit.any(axis=1), block[part] * BLOCK + hit.argmax(axis=1), -1)
        return out

    def find_close(self, places: np.ndarray) -> np.ndarray:
        """The close of each open place."""
        bound = self.excess[places]
        block = places // BLOCK
        out = self.first_below(block, places % BLOCK + 1, bound)
        todo = np.flatnonzero(out < 0)
        node = block[todo] + self.blocks
        rising = np.ones(len(todo), bool)
        while rising.any():  # to the first right neighbour that goes low enough
            left = node % 2 == 0
            beside = np.where(left, node + 1, node)
            good = rising & left & (self.tree[beside] < bound[todo])
            node = np.where(good, beside, np.where(rising, node // 2, node))
            rising &= ~good
        while (node < self.blocks).any():
            inner = node < self.blocks
            low = np.where(inner, 2 * node, node)
            node = np.where(inner & (self.tree[low] >= bound[todo]), low + 1, low)
        out[todo] = self.first_below(node - self.blocks, np.zeros(len(todo), np.int64), bound[todo])
        return out

    def leaves_between(self, places: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """How many pairs of an open and its close side by side lie from each place to its close."""
        return self.leaves[closes] - self.leaves[places]
