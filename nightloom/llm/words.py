"""Words of whole Arrow text columns as NumPy arrays: one pass over the UTF-8 bytes.

A word is a maximal run of word bytes; A-Z count as a-z. Delimiters are ASCII, so bytes are safe.
Word hashes are 64-bit polynomial hashes from prefix sums, finished with a mixing step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text looked at in one go; a longer text is one slice by itself.
SLICE = 1 << 18
BASE, C1, C2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
INVERSE = U(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but blank and the controls 9 to 13.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: Digits, letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def powers(base: U, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * C1
    h = (h ^ (h >> U(27))) * C2
    return h ^ (h >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of some rows: start, end (bytes in data), hash; those of row r are first[r]:first[r + 1]."""

    def __init__(self, at: np.ndarray, data: np.ndarray, is_word: np.ndarray):
        n = len(data)
        self.data = LOWER[data]
        on = is_word[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = on[:-1]
        start = np.flatnonzero(on & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = on[1:]
        self.start, self.end = start, np.flatnonzero(on & (~after | edge[1:])) + 1
        self.first = np.searchsorted(start, at)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum((self.data.astype(U) + U(1)) * powers(BASE, n), out=self.sums[1:])
        self.unbase = powers(INVERSE, n + 1)
        self.hash = self.piece(start, self.end)

    def piece(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self.sums[end] - self.sums[start]) * self.unbase[start] + U(1))

    def ngrams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, over all rows (the caller leaves out those that cross rows)."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, dtype=U)
        sums = np.zeros(len(h) + 1, dtype=U)
        np.cumsum(h * powers(C1, len(h)), out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * powers(U(pow(int(C1), -1, 1 << 64)), len(h) - n + 1) + U(n))

    def of(self, row: int) -> tuple[int, int]:
        return int(self.first[row]), int(self.first[row + 1])


def words(column: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) for slices of a text column."""
    at, data = text_bytes(column)
    for i, j in slices(at):
        yield i, j, Words(at[i : j + 1] - at[i], data[at[i] : at[j]], is_word)
    # workers live on after their task: what it took goes back to the machine
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
