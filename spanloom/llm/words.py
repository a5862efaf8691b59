"""Words of a batch of texts as arrays of hashes, without a Python loop over words.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r;
the separators are single bytes, so whole UTF-8 buffers are cut at once.
A word's hash has 64 bits: a sum of its bytes, eight at a time, each eight mixed
with their place by a function without structure, A-Z in lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins and ends (n + 1 offsets); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 2_000_000):
    """Ranges of rows of about so many bytes together; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends in data, and where each row's words begin among them (n + 1 offsets)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: eight bytes at a time, each mixed with its place, then summed and mixed with the length."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    pieces = np.maximum((size + 7) >> 3, 1)
    begin = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(begin, pieces)
    left = np.repeat(size, pieces) - 8 * place
    value = eight[np.repeat(starts, pieces) + 8 * np.where(left > 0, place, 0)] & _BYTES[np.clip(left, 0, 8)]
    salts = mix(np.arange(1, int(pieces.max()) + 1, dtype=np.uint64))
    sums = np.add.reduceat(mix(value + salts[place]), begin)
    return mix(sums + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z in lower case, and where each row's words begin."""
    starts, ends, at = spans(data, offsets)
    return span_hashes(LOWER[data], starts, ends), at


def same_bytes(data: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of equal size that begin at start and at other hold the same bytes."""
    if not len(size):
        return np.zeros(0, bool)
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    differ = np.zeros(len(place) + 1, np.int64)
    np.cumsum(data[np.repeat(start, size) + place] != data[np.repeat(other, size) + place], out=differ[1:])
    return differ[begin + size] == differ[begin]


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number below the count of spans for each, equal where the bytes are: hashes find them, bytes confirm them."""
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[first[which]]
    if same.all() and same_bytes(data, starts, starts[first[which]], size).all():
        return which
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[i:j].tobytes(), len(known)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


class Table:
    """Rows of numbers by 64-bit key: open addressing, at most half full, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys, self.index = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.rows, self.steps = rows, 0
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == 0
            taken, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[taken], self.index[taken] = keys[left[chosen]], left[chosen]
            stay = np.ones(len(left), bool)
            stay[chosen] = False
            slot, left = (slot[stay] + 1) & ((1 << self.bits) - 1), left[stay]
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's row, -1 if there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.index[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        for step in range(1, self.steps):
            if not len(open_):
                break
            at = (slot[open_] + step) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.index[at[hit]]
            open_ = open_[~hit & (there != 0)]
        return out
