"""Minimal perfect hashes of 64-bit keys as numpy arrays.

Keys go to a bit array somewhat larger than their number; those that are alone on their bit are placed, the others go on
to the next, smaller array.  A key's slot is the number of set bits before its own.  A foreign key gets some slot or none:
whoever looks up compares with the key stored for the slot.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_STEP = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(_STEP * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 of n different 64-bit keys."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        count = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(count) - count
        self.n = int(count.sum())

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.6) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            if len(sizes) == 500:
                raise ValueError("keys are not different")
            size = max(64, -(-int(room * len(keys)) // 64) * 64)
            at = _place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, "<i8"), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that are none of the keys."""
        out = np.full(len(keys), -1, np.int64)
        todo, first = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = _place(keys[todo], level, size)
            word, bit = self.words[first + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = self.before[first + (at[hit] >> 6)] + lower[hit]
            todo = todo[~hit]
            first += size // 64
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes)], "<i8").tobytes() + self.sizes.tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        return cls(np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<u8", offset=8 + 8 * n))
