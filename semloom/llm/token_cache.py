"""Word-level caches for Python workers: a word's derived arrays are computed once and gathered by NumPy."""

from __future__ import annotations

import numpy as np

LIMIT = 300_000  # words held before a cache starts anew, so its memory is bounded


class WordTable(dict):
    """word -> row of growing arrays; `make(words)` returns the arrays' new rows for unseen words."""

    def __missing__(self, word):
        row = self[word] = len(self)
        self.fresh.append(word)
        return row

    def __init__(self):
        super().__init__()
        self.fresh = []

    def rows(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def full(self, limit: int = LIMIT) -> bool:
        return len(self) > limit


class Ragged:
    """Arrays of different length, one for each row of a WordTable, in one flat array."""

    def __init__(self, dtype=np.int32):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.starts, self.sizes, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def grow(self, n: int) -> int:
        """Room for n more rows; returns the first of them. put() fills them, in any order."""
        while self.n + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.n += n
        return self.n - n

    def put(self, rows: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The arrays of these rows, one after the other in flat."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[rows] = self.used + np.cumsum(sizes) - sizes
        self.sizes[rows] = sizes
        self.used += len(flat)

    def extend(self, arrays) -> None:
        arrays = [np.asarray(a, self.flat.dtype) for a in arrays]
        if arrays:
            first = self.grow(len(arrays))
            self.put(np.arange(first, self.n), np.concatenate(arrays), np.fromiter(map(len, arrays), np.int64, len(arrays)))

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The arrays of these rows, one after the other."""
        size = self.sizes[rows]
        ends = np.cumsum(size)
        if not len(rows) or not ends[-1]:
            return self.flat[:0]
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - size), size)]
