"""Words and word shingles of Arrow string columns, as 64-bit hashes in NumPy.

A word is a run of ``0-9``, ``a-z`` (after lower-casing ``A-Z``) and bytes of non-ASCII characters, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text. All functions work on the UTF-8 bytes of a
slice of rows at once; slices are cut so that temporaries stay small however many rows a batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into words at a time (a single longer text makes a slice of its own).
SLICE_BYTES = 1 << 18
#: Words of a shingle.
SHINGLE = 5

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether it belongs to a word, and a random odd value of its lower case."""
    byte = np.arange(256)
    word = ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    return word, mix(lower.astype(U) * U(0xD1B54A32D192ED03) + U(1)) | U(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        made = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 4 * SLICE_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (n + 1) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """``(first row, row after the last, texts)`` for slices of a string column; null is empty."""
    offsets, _ = text_column(column)
    for first, last in slices(offsets, most):
        yield first, last, [t or "" for t in column.slice(first, last - first).to_pylist()]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """The words of a slice of rows: their bytes' bounds in the slice and the index of the first word of each row."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        is_word, value = _tables()
        bytes_ = data[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        n = len(bytes_)
        inside = is_word[bytes_]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[bounds] = False
        self.starts = np.flatnonzero(inside & ~before[:n])
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[bounds] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.rows = np.searchsorted(self.starts, bounds)
        power, self._inverse = powers(n + 1)
        self._sums = np.zeros(n + 1, U)
        np.cumsum(value[bytes_] * power[:n], out=self._sums[1:])

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return mix((self._sums[ends] - self._sums[self.starts]) * self._inverse[self.starts])


def word_batches(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """``(first row, row after the last, words)`` for slices of a string column."""
    offsets, data = text_column(column)
    for first, last in slices(offsets, most):
        yield first, last, Words(offsets[first : last + 1], data)


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of every run of ``width`` words, in order of rows.

    A row of fewer words, but one at least, has one shingle of all its words; a row without words has none.
    """
    word, first = words.hashes(), words.rows
    counts = np.diff(first)
    position = np.arange(len(word)) - np.repeat(first[:-1], counts)
    left = np.repeat(counts, counts) - position
    keep = (left >= width) | (position == 0)
    out = np.zeros(len(word), U)
    padded = np.concatenate([word, np.zeros(width, U)])
    for k in range(width):
        part = padded[k : k + len(word)]
        out = (out ^ np.where(left > k, part, U(0))) * _BASE + U(k + 1)
        out ^= out >> U(29)
    row = np.repeat(np.arange(len(counts)), counts)
    return mix(out[keep]), row[keep]


def distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, concatenated, and the n + 1 bounds of the rows. ``rows`` ascends."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, np.searchsorted(rows, np.arange(n + 1))
