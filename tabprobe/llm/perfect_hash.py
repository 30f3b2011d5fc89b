"""A minimal perfect hash over distinct 64-bit keys: n keys to the numbers 0 to n-1, at about three bits a key.

Level by level, keys are thrown into a table of bits twice their number; those alone in their place are done, the others go
on to the next level with another seed. A key's number is the count of set bits before its own.
"""

from __future__ import annotations

import numpy as np

#: Places per key and level.
ROOM = 2


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits per key (multiply and shift, twice)."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """``sizes``: bits of each level, a multiple of 64; ``words``: all levels' bits in words of 64."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.n = int(self.before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` must be distinct."""
        sizes, levels = [], []
        left = keys.astype(np.uint64)
        while len(left):
            size = max(64, -(-ROOM * len(left) // 64) * 64)
            place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; for strangers some number, or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        rows, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(rows):
                break
            place = (mixed(keys[rows], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            found = self.words[word]
            hit = (found >> bit) & np.uint64(1) == 1
            below = found & ((np.uint64(1) << bit) - np.uint64(1))
            out[rows[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            rows, start = rows[~hit], start + size
        return out
