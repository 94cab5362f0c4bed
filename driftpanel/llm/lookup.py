"""A hash table of 64-bit keys for whole arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPREAD = U(0x9E3779B97F4A7C15)


class Lookup:
    """Positions of 64-bit keys, found for whole arrays at once."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = keys.astype(U)
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = U(size - 1), U(65 - size.bit_length())
        self.keys, self.at = np.zeros(size, U), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            self.keys[slot[free]] = keys[left[free]]
            wait = self.at[slot] != left
            left, slot = left[wait], (slot[wait] + U(1)) & self.mask
        # A value that is no key tells free slots, so `at` is read for keys that are there alone.
        free = np.arange(len(keys) + 1, dtype=U)
        self.free = free[~np.isin(free, keys)][0]
        self.keys[:] = self.free
        self.keys[self.at >= 0] = keys[self.at[self.at >= 0]]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * SPREAD) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        keys = keys.astype(U, copy=False)
        slot, left = self.slots(keys), None
        while len(slot):
            there = self.keys[slot]
            same = there == keys
            hit = np.flatnonzero(same)
            out[hit if left is None else left[hit]] = self.at[slot[hit]]
            go = np.flatnonzero(~same & (there != self.free))
            left = go if left is None else left[go]
            keys, slot = keys[go], (slot[go] + U(1)) & self.mask
        return out
