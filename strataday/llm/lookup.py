"""A table from 64-bit keys to row numbers, looked up for many keys at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)


class Lookup:
    """Row numbers of distinct keys by open addressing with linear probing.

    ``places`` is at least twice the number of keys, so a probe rarely goes on.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._place(keys)
        while len(left):
            free = self.rows[at] < 0
            # Of several keys at one free place, the last written stays.
            self.rows[at[free]] = left[free]
            self.keys[at[free]] = keys[left[free]]
            stays = self.rows[at] == left
            left, at = left[~stays], (at[~stays] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 for keys that the table doesn't hold."""
        at = self._place(keys)
        out = self.rows[at]
        left = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            row = self.rows[at]
            out[left] = row
            on = (self.keys[at] != keys[left]) & (row >= 0)
            left, at = left[on], at[on]
        return out
