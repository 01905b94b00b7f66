"""Minimal perfect hashing of 64-bit keys with numpy.

Level by level, the keys left are hashed into a bit array a little larger than their number; keys
alone in their place stay there, the rest go on to the next level. A key's index is the number of
set bits before its own. Lookups are vectorised and touch one bit per level, few levels on average.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.7
LEVELS = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of keys under a seed."""
    x = keys.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class PerfectHash:
    """Index 0..n-1 for each of ``n`` distinct keys; any other key gets some index or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits.astype(np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, parts = np.asarray(keys, dtype=np.uint64), [], []
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys didn't come apart")
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            low = np.bitwise_count(self.bits[byte[hit]] & ((np.uint8(1) << bit[hit]) - np.uint8(1)).astype(np.uint8))
            out[open_[hit]] = self.words[byte[hit]] + low
            open_ = open_[~hit]
        return out
