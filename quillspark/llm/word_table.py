"""Many words at once: their hashes, and an open-addressing table of ids, in numpy arrays.

A word of up to 16 bytes is its own key: two 64-bit halves and its length, so equal
keys are equal words. Look-ups and insertions work on whole arrays of words.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

#: Bytes of the longest word that has a key.
LONGEST = 16
#: Places at first, and at most, in bits; half of them are filled at most.
LEAST_BITS, MOST_BITS = 16, 22
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def halves(padded: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys' halves of words in a buffer that goes on for LONGEST bytes behind the last one."""
    at = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
    return at[starts] & _MASK[np.minimum(sizes, 8)], at[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, runs of bytes other than blank and \\t to \\r."""
    if not texts:
        return []
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    buffer = b" ".join(texts) + b" " + bytes(LONGEST)
    inside = ~_SPACE[np.frombuffer(buffer, np.uint8, len(buffer) - LONGEST)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    low, high = halves(buffer, starts, sizes)
    out = mix(low ^ mix(high, 1) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]])
    return np.split(out, np.searchsorted(starts, ends_of_texts)[:-1])


class WordTable:
    """For each word known, where its ids lie in ``ids`` and how many they are."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.ids = np.empty(1 << 16, np.uint32)
        self._room(LEAST_BITS)

    def _room(self, bits: int) -> None:
        self.bits, size = bits, 1 << bits
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.size = np.zeros(size, np.uint8)
        self.first, self.count = np.zeros(size, np.int32), np.zeros(size, np.uint16)

    def _slot(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high, 1) ^ sizes.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place of each word; -1 for those that aren't known."""
        slot, todo = self._slot(low, high, sizes), np.arange(len(low))
        out = np.full(len(low), -1, np.int64)
        while len(todo):
            at = slot[todo]
            there = self.size[at]
            same = (there == sizes[todo]) & (self.low[at] == low[todo]) & (self.high[at] == high[todo])
            out[todo[same]] = at[same]
            todo = todo[~same & (there > 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def place(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Appends ids of words; gives where they lie, and how many they are."""
        count = np.array([len(x) // 4 for x in ids], np.int64)
        first = self.used + np.cumsum(count) - count
        total = self.used + int(count.sum())
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(total, len(self.ids)), np.uint32)])
        self.ids[self.used : total] = np.frombuffer(b"".join(ids), "<u4")
        self.used = total
        return first, count

    def add(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Adds words that aren't known, each once, whose ids are placed."""
        while 2 * (self.n + len(low)) > 1 << self.bits:
            old = np.flatnonzero(self.size)
            rows = [x[old] for x in (self.low, self.high, self.size, self.first, self.count)]
            self._room(self.bits + 1)
            self._insert(*rows)
        self._insert(low, high, sizes, first, count)
        self.n += len(low)

    def _insert(self, low, high, sizes, first, count) -> None:
        slot, todo = self._slot(low, high, sizes), np.arange(len(low))
        while len(todo):
            at = slot[todo]
            free = self.size[at] == 0
            # Of several words for one free place one gets it.
            at_free, who = np.unique(at[free], return_index=True)
            won = todo[free][who]
            for table, values in ((self.low, low), (self.high, high), (self.size, sizes), (self.first, first), (self.count, count)):
                table[at_free] = values[won]
            left = np.ones(len(low), bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @property
    def full(self) -> bool:
        return 2 * self.n > 1 << (MOST_BITS - 1) or self.used > 1 << 28
