"""Words of Arrow text columns as arrays.

A word is a longest run of digits, letters a-z (A-Z are lower-cased first) and
characters beyond ASCII. A batch of texts is cut into blocks of whole texts, so the
arrays of a block are bounded by ``BLOCK_BYTES`` or by the longest text. Words get
64-bit hashes: equal words have equal hashes, and callers that need certainty compare
the words behind equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

# Odd multipliers, so that every power has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` of them."""
    if len(_powers[0]) < n:
        for slot, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[slot] = np.multiply.accumulate(factors)
    return _powers


@dataclass
class WordBlock:
    """The words of some consecutive texts; text ``i`` has the words from ``offsets[i]`` to ``offsets[i + 1]``."""

    first: int
    data: np.ndarray
    text_offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @cached_property
    def hashes(self) -> np.ndarray:
        """A hash per word: its bytes as digits of a number modulo 2^64, then mixed."""
        powers, inverses = _power_tables(len(self.data) + 1)
        summed = np.zeros(len(self.data) + 1, np.uint64)
        digits = self.data.astype(np.uint64)
        digits += np.uint64(1)
        digits *= powers[: len(digits)]
        np.cumsum(digits, out=summed[1:])
        return mix((summed[self.ends] - summed[self.starts]) * inverses[self.starts])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``length`` consecutive words of one text, and the first word of each."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes = hash_runs(self.hashes, length)
        text = np.repeat(np.arange(self.texts), self.counts)
        first = np.flatnonzero(text[:n] == text[length - 1 :])
        return hashes[first], first

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def hash_runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` neighbours, which depends on their order."""
    n = len(hashes) - length + 1
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += hashes[j : j + n] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64))
    total += np.uint64(length)
    return mix(total)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without gaps, and where each text begins; null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """First text and number of texts of slices of at most ``block_bytes``, or of one text."""
    _, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1)
        yield first, last - first
        first = last


def word_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[WordBlock]:
    """The words of a text column, some texts at a time."""
    data, offsets = text_bytes(column)
    for first, count in text_slices(column, block_bytes):
        own = offsets[first : first + count + 1]
        yield _block(first, data[own[0] : own[-1]], own - own[0])


def _block(first: int, raw: np.ndarray, text_offsets: np.ndarray) -> WordBlock:
    data = _LOWER[raw]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = text_offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[1:-1][edges]
    stops[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return WordBlock(first, data, text_offsets, starts, ends, np.searchsorted(starts, text_offsets))


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each text's words."""
    running = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]
