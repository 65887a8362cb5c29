"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
NARROW = 512


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last counts as smaller."""
    change = np.flatnonzero(text[:-1] != text[1:])
    out = np.ones(len(text), bool)
    end = change[-1] + 1 if len(change) else 0
    out[:end] = np.repeat(text[change] < text[change + 1], np.diff(change, prepend=-1))
    return out


def _place(array: np.ndarray, text: np.ndarray, suffixes: np.ndarray, next_: np.ndarray, step: int) -> None:
    """Appends suffixes to the buckets of their first symbols, in the order given."""
    symbols = text[suffixes]
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    first = np.flatnonzero(np.diff(symbols, prepend=-1))
    counts = np.diff(np.append(first, len(symbols)))
    within = np.arange(len(symbols)) - np.repeat(first, counts)
    array[next_[symbols] + step * within] = suffixes
    next_[symbols[first]] += step * counts


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, induced from the leftmost smaller ones in order.

    Larger suffixes are placed from the smallest bucket up, smaller ones from the largest
    down; a bucket that fills itself is gone through in rounds.
    """
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    heads, bound = ends - counts, ends - counts
    heads = heads.astype(np.int64).copy()
    array = np.full(len(text), -1, np.int64)
    by = np.searchsorted(text[seeds[np.argsort(text[seeds], kind="stable")]], np.arange(size + 1))
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    present = np.flatnonzero(counts)
    for c in present:
        low = bound[c]
        while low < heads[c]:
            part, low = array[low : heads[c]], heads[c]
            before = part[part > 0] - 1
            before = before[~small[before]]
            if len(before):
                _place(array, text, before, heads, 1)
        part = seeds[by[c] : by[c + 1]]
        before = part[part > 0] - 1
        before = before[~small[before]]
        if len(before):
            _place(array, text, before, heads, 1)
    tails = ends.astype(np.int64) - 1
    for c in present[::-1]:
        high = ends[c]
        while tails[c] + 1 < high:
            part, high = array[tails[c] + 1 : high][::-1], tails[c] + 1
            before = part[part > 0] - 1
            before = before[small[before]]
            if len(before):
                _place(array, text, before, tails, -1)
        part = array[bound[c] : heads[c]][::-1]
        before = part[part > 0] - 1
        before = before[small[before]]
        if len(before):
            _place(array, text, before, tails, -1)
    array[0] = len(text) - 1  # the end is smallest and nothing induces it
    return array


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of pairs of numbers below 2^31."""
    return np.unique((high.astype(np.int64) << 32) | low, return_inverse=True)[1]


def _tails(text: np.ndarray, small: np.ndarray, left: np.ndarray, end_rank: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by their symbols up to the next leftmost smaller suffix, then by its rank.

    For alphabets too wide for buckets: pointers to the rest of a tail are doubled.
    """
    n = len(text)
    symbol = 2 * text.astype(np.int64) + small
    after = np.append(symbol[1:], 0)
    rank = _dense(_dense(symbol, after), np.append(np.where(left[1:], end_rank[1:] + 1, 0), 0))
    last = np.append(left[1:], True)
    jump = np.where(last, n, np.arange(1, n + 1))
    while (jump < n).any():
        rank = _dense(rank, np.append(rank + 1, 0)[jump])
        jump = np.append(jump, n)[jump]
    return rank


def _names(text: np.ndarray, small: np.ndarray, left: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the substrings between leftmost smaller suffixes, in text order."""
    if size > NARROW:
        return np.unique(_tails(text, small, left, np.zeros(len(text), np.int64))[places], return_inverse=True)[1]
    order = _induce(text, small, places, size)
    order = order[left[order]]
    until = np.append(places[1:], len(text) - 1)
    length = np.zeros(len(text), np.int64)
    length[places] = until - places + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_ = np.flatnonzero(same)
    d = 0
    while len(open_):
        equal = (text[a[open_] + d] == text[b[open_] + d]) & (small[a[open_] + d] == small[b[open_] + d])
        same[open_[~equal]] = False
        d += 1
        open_ = open_[equal]
        open_ = open_[length[a[open_]] > d]
    name = np.zeros(len(text), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    return name[places]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a text in order. The last symbol is 0 and occurs once; symbols are below 2^31."""
    n, size = len(text), int(text.max()) + 1
    if n < 3:
        return np.argsort(text, kind="stable")[: n]
    small = _types(text)
    left = small & np.append([False], ~small[:-1])
    places = np.flatnonzero(left)
    names = _names(text, small, left, places, size)
    if names.max() + 1 < len(places):
        order = suffix_array(names)
    else:
        order = np.argsort(names)
    if size <= NARROW:
        return _induce(text, small, places[order], size)
    rank = np.zeros(n, np.int64)
    rank[places[order]] = np.arange(len(places))
    return np.argsort(_tails(text, small, left, rank), kind="stable")


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order, the one before it in the array (or -1) and the length of their common prefix.

    Where both have the same symbol in front, the length is one less than that of the
    suffix before; the others are compared, eight symbols at a time. Symbols are bytes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 8]
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    known = before >= 0
    plain = known.copy()
    plain[1:] &= (before[1:] <= 0) | (before[:-1] < 0) | (text[:-1] != text[before[1:] - 1])
    plain |= ~known
    at = np.flatnonzero(plain & known)
    other, length = before[at], np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        i, j = at[open_] + length[open_], other[open_] + length[open_]
        differ = words[np.minimum(i, n + 7)] ^ words[np.minimum(j, n + 7)]
        equal = differ == 0
        low = differ[~equal]
        low &= ~low + np.uint64(1)
        length[open_[~equal]] += (np.log2(low.astype(np.float64)).astype(np.int64)) >> 3
        open_ = open_[equal]
        length[open_] += 8
        open_ = open_[np.maximum(at[open_], other[open_]) + length[open_] < n]
    out = np.zeros(n, np.int64)
    out[at] = length
    source = np.maximum.accumulate(np.where(plain, np.arange(n), -1))
    out = np.maximum(out[source] - (np.arange(n) - source), 0)
    out[~known] = 0
    return before, np.minimum(out, n - np.maximum(np.arange(n), before))
