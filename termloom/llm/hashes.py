"""Sorted arrays of 64-bit hashes that whole arrays are looked up in."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class SortedHashes:
    """Sorted distinct hashes with a row of numbers each; their leading bits tell where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = _U(64 - bits)
        self.keys = np.concatenate([keys[order], np.zeros(1, _U)])
        self.values = values[order]
        self.first = np.searchsorted(keys[order] >> self.shift, np.arange((1 << bits) + 1, dtype=_U)).astype(np.int32)

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        # where to look is found again by each worker: it is larger than the hashes, and broadcasts lie on every disk
        return self.keys[:-1], self.values

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.__init__(*state)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.where((self.keys[at] == keys) & (at < end), at, -1)
        todo = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(todo):
            at[todo] += 1
            hit = self.keys[at[todo]] == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            todo = todo[at[todo] + 1 < end[todo]]
        return out
