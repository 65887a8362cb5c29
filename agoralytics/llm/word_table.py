"""A bounded memory of word -> ids, kept by each Python worker as flat arrays."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all entries of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class WordTable:
    """Encodes each distinct word once; forgets all when it holds too many characters."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 12_000_000):
        self._encode, self._most = encode, most
        self.forget()

    def forget(self) -> None:
        """Gives up all words and their room."""
        self._code: dict[str, int] = {}
        self._held = self._used = 0
        self._ids, self._starts, self._lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids held, where in them the ids of each word begin, and how many it has."""
        if self._held > self._most:
            self.forget()
        codes = np.fromiter(map(self._code.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(words[i] for i in unknown))
            ids, lengths = self._encode(new)
            n, have = len(self._code), len(new)
            self._starts, self._lengths = self._room(self._starts, n + have), self._room(self._lengths, n + have)
            self._ids = self._room(self._ids, self._used + len(ids))
            self._ids[self._used : self._used + len(ids)] = ids
            self._lengths[n : n + have] = lengths
            self._starts[n : n + have] = self._used + np.cumsum(lengths) - lengths
            self._used += len(ids)
            self._held += sum(map(len, new))
            self._code.update(zip(new, range(n, n + have), strict=True))
            codes[unknown] = [self._code[words[i]] for i in unknown]
        return self._ids[: self._used], self._starts[codes], self._lengths[codes]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        held, starts, lengths = self.places(words)
        return held[spread(starts, lengths)], lengths
