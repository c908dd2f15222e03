"""Words of many texts as 64-bit hashes, and tables that are looked up by such hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_K = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes that are hashed at once.
GROUP = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """texts in runs of about GROUP bytes."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield group


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word between white space, and for each text the number of words up to its end."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    white = WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    first, end = edge[0::2], edge[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    length = end - first
    letters = np.flatnonzero(~white)
    place = letters - np.repeat(first, length)
    powers = np.multiply.accumulate(np.full(int(length.max()) + 1, _K))
    sums = np.add.reduceat(_VALUES[data[letters]] * powers[place], np.concatenate([[0], np.cumsum(length)[:-1]]))
    return mixed(sums + length.astype(np.uint64)), np.searchsorted(first, stops)


class KeyTable:
    """Finds places of 64-bit hashes in a sorted array, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        edges = np.arange((1 << self.bits) + 1, dtype=np.float64)
        heads = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(heads, edges).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places in the array; -1 for what isn't there."""
        head = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[head], self.first[head + 1]
        out = np.full(len(wanted), -1, np.int64)
        rows = np.flatnonzero(at < stop)
        at, stop, wanted = at[rows], stop[rows], wanted[rows]
        while len(rows):
            hit = self.keys[at] == wanted
            out[rows[hit]] = at[hit]
            on = ~hit & (at + 1 < stop)
            rows, at, stop, wanted = rows[on], at[on] + 1, stop[on], wanted[on]
        return out
