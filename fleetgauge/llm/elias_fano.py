"""Monotone sequences by Elias and Fano, as arrays that can lie in a mapped file.

The low bits of each value are packed side by side; the high bits are written in unary: a one for each
value and a zero after each bucket of equal high bits. The place of every 32nd zero is sampled. All
lookups take arrays of questions.
"""

from __future__ import annotations

import numpy as np

STEP = 32


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, one after the other, in 64-bit words (and one more, to read across)."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = (shift + np.uint64(width)) > np.uint64(64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def _unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[word] >> shift) | high) & np.uint64((1 << width) - 1)


def _place_table() -> np.ndarray:
    """The place of set bit number r of byte b, at r * 256 + b."""
    places = np.zeros((8, 256), np.uint8)
    for byte in range(256):
        for rank, place in enumerate(i for i in range(8) if byte >> i & 1):
            places[rank, byte] = place
    return places.ravel()


PLACES = _place_table()
EVERY_BYTE = np.uint64(0x0101010101010101)


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit number `rank` (from 0) of each word."""
    counts = np.bitwise_count(words.view(np.uint8)).view(np.uint64)
    upto = (counts * EVERY_BYTE).view(np.uint8).reshape(-1, 8)
    byte = (upto <= rank[:, None]).sum(1)
    each = np.arange(len(words))
    before = np.where(byte > 0, upto[each, byte - 1], 0)
    return byte * 8 + PLACES[(rank - before) * 256 + words.view(np.uint8).reshape(-1, 8)[each, byte]]


class EliasFano:
    """`values` ascend and lie below `universe`; `parts()` are the arrays to store."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        tops = (values >> np.uint64(width)).astype(np.int64)
        buckets = (universe >> width) + 1
        bits = np.zeros(n + buckets + 64, np.uint8)
        bits[tops + np.arange(n)] = 1
        high = np.packbits(bits[: len(bits) // 64 * 64], bitorder="little").view(np.uint64)
        # Zero number b ends bucket b: it stands behind the values up to that bucket and b other zeros.
        numbers = np.arange(0, buckets, STEP)
        kind = np.uint32 if n + buckets < 1 << 32 else np.uint64
        ones = (tops[::STEP] + np.arange(0, n, STEP)).astype(kind)
        zeros = (np.searchsorted(tops, numbers, "right") + numbers).astype(kind)
        return cls(n, width, _pack(values & np.uint64((1 << width) - 1), width), high, ones, zeros)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Where one, or zero, number k stands in the unary bits."""
        samples, flip = (self.ones, np.uint64(0)) if ones else (self.zeros, ~np.uint64(0))
        at, skip = samples[k // STEP].astype(np.int64), k % STEP
        word = at >> 6
        left = (self.high[word] ^ flip) & (~np.uint64(0) << (at & 63).astype(np.uint64))
        count = np.bitwise_count(left).astype(np.int64)
        far = np.flatnonzero(skip >= count)
        while len(far):
            skip[far] -= count[far]
            word[far] += 1
            left[far] = self.high[word[far]] ^ flip
            count[far] = np.bitwise_count(left[far])
            far = far[skip[far] >= count[far]]
        return word * 64 + _select_in_word(left, skip)

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 64 unary bits from place `at` on; behind the last word, anything."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        later = self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63))
        return (self.high[word] >> shift) | np.where(shift > 0, later, np.uint64(0))

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at places `at`."""
        if not len(at):
            return np.empty(0, np.uint64)
        top = self._select(at, True) - at
        return (top.astype(np.uint64) << np.uint64(self.width)) | _unpack(self.low, self.width, at)

    def access_two(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places `at`, and those behind them."""
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        here = self._select(at, True)
        ahead = self._window(here + 1)
        there = here + 1 + np.bitwise_count((ahead & (~ahead + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        # The next one may lie further off than the window shows.
        far = np.flatnonzero(ahead == 0)
        there[far] = self._select(at[far] + 1, True)
        tops = ((there_ - at_).astype(np.uint64) << np.uint64(self.width) for there_, at_ in ((here, at), (there, at + 1)))
        return tuple(top | _unpack(self.low, self.width, at_) for top, at_ in zip(tops, (at, at + 1)))

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: the successor within its bucket, if it is the value."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        top = (values >> np.uint64(self.width)).astype(np.int64)
        here, inner = np.zeros(len(values), np.int64), top > 0
        here[inner] = self._select(top[inner] - 1, False) + 1
        begin = here - top
        # The bucket's values are the ones from here to the next zero.
        ahead = self._window(here)
        end = begin + np.bitwise_count(ahead & ~(ahead + np.uint64(1)))
        far = np.flatnonzero(~ahead == 0)
        end[far] = self._select(top[far], False) - top[far]
        low = values & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            got = _unpack(self.low, self.width, begin[open_])
            same = got == low[open_]
            out[open_[same]] = begin[open_[same]]
            go_on = got < low[open_]
            open_ = open_[go_on]
            begin[open_] += 1
            open_ = open_[begin[open_] < end[open_]]
        return out
