"""Monotone sequences of whole numbers in Elias-Fano form, read from memory-mapped arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONES = _U(0x0101010101010101)  # one in each byte
_TOPS = _U(0x8080808080808080)
#: Place of the r-th set bit in a byte.
_PLACE = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """values ascending (repeats allowed): low bits packed, high bits in unary.

    The i-th value's high part h sets bit h + i, so zeros end the buckets of
    equal high parts: a search needs the places of two zeros and then halves
    one bucket, of one or two values on average.
    """

    def __init__(self, values: np.ndarray):
        values = values.astype(_U)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.width = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = (values >> _U(self.width)).astype(np.int64)
        self.buckets = (int(high[-1]) if self.n else 0) + 1
        bits = np.zeros(-(-(self.n + self.buckets + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.high = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(self.high.view(_U)).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32 if self.n < 1 << 32 else _U)
        # The low parts lie one after another, width bits each.
        bit = np.arange(self.n, dtype=np.int64) * self.width
        self.low = np.zeros(-(-(self.n * self.width) // 64) + 2, _U)
        part = values & _U((1 << self.width) - 1)
        np.bitwise_or.at(self.low, bit >> 6, part << (bit & 63).astype(_U))
        over = ((bit & 63) + self.width > 64) & (self.width > 0)
        np.bitwise_or.at(self.low, (bit[over] >> 6) + 1, part[over] >> (64 - (bit[over] & 63)).astype(_U))

    ARRAYS = ("high", "ones", "low")

    def _select(self, ranks: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the rank-th one (or zero) bit."""
        before = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if zeros else self.ones.astype(np.int64)
        word = np.searchsorted(before, ranks, side="right") - 1
        left = (ranks - before[word]).astype(_U)
        bits = self.high.view(_U)[word]
        if zeros:
            bits = ~bits
        # Set bits up to the end of each byte, all eight at once; then the byte in which the one asked for lies.
        sums = bits - ((bits >> _U(1)) & _U(0x5555555555555555))
        sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
        sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
        byte = ((((left * _ONES) | _TOPS) - sums & _TOPS) >> _U(7)) * _ONES >> _U(56)
        shift = byte << _U(3)
        earlier = (sums << _U(8)) >> shift & _U(0xFF)
        place = _PLACE[((bits >> shift) & _U(0xFF)).astype(np.int64), (left - earlier).astype(np.int64)]
        return word * 64 + shift.astype(np.int64) + place

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        shift = (bit & 63).astype(_U)
        a = self.low[bit >> 6] >> shift
        b = np.where(shift > 0, self.low[(bit >> 6) + 1] << (_U(64) - np.maximum(shift, _U(1))), _U(0))
        return (a | b) & _U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, False) - i).astype(_U)
        return (high << _U(self.width)) | self._low(i)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """For each value, the place of the first element that is not smaller (n if there is none)."""
        values = values.astype(_U)
        high = (values >> _U(self.width)).astype(np.int64)
        inside = high < self.buckets
        out = np.full(len(values), self.n, np.int64)
        high, low = high[inside], (values & _U((1 << self.width) - 1))[inside]
        start = np.zeros(len(high), np.int64)
        later = high > 0
        start[later] = self._select(high[later] - 1, True) - (high[later] - 1)
        end = self._select(high, True) - high
        open_ = np.flatnonzero(start < end)
        while len(open_):  # halve the rest of each bucket
            middle = (start[open_] + end[open_]) >> 1
            less = self._low(middle) < low[open_]
            start[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[start[open_] < end[open_]]
        out[inside] = start
        return out
