"""Whole-batch text kernels over Arrow string buffers: no loop over words or bytes.

A word is a maximal run of ASCII letters, digits and bytes from 0x80 on (all of
UTF-8's multi-byte characters), with ASCII letters in lower case. White space is
a byte up to 0x20; the bytes left are punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 18
SPACE, WORD, PUNCT = 0, 1, 2

_b = np.arange(256)
KIND = np.where(_b <= 32, SPACE, PUNCT).astype(np.uint8)
KIND[(_b >= 128) | ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122))] = WORD
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U)[LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
STEPS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 2**64) for k in range(32)], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = 1
    return np.cumprod(out, out=out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and validity of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets, valid


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes; a longer text is a range of its own, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Hashed words of the rows i..j: row r (from 0) has the words bounds[r]..bounds[r+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, punctuation: bool = False):
        base = offsets[i]
        own, edges = data[base : offsets[j]], (offsets[i : j + 1] - base)
        n = len(own)
        kind = KIND[own]
        if not punctuation:
            kind = np.where(kind == WORD, np.uint8(WORD), np.uint8(SPACE))
        change = np.empty(n + 1, bool)
        change[0] = change[n] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:n]) if n else None
        change[edges] = True
        cuts = np.flatnonzero(change)
        starts, ends = cuts[:-1], cuts[1:]
        real = kind[starts] != SPACE if n else np.zeros(0, bool)
        self.starts, self.ends = starts[real], ends[real]
        self.bounds = np.searchsorted(self.starts, edges)
        global _powers, _inverses
        if len(_powers) < n:
            _powers, _inverses = powers(n, _BASE), powers(n, _INVERSE)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[own] * _powers[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * _inverses[self.starts])

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams that lie within a row, and their bounds by row. A row of 1 to n-1 words has one: all of its words."""
        h, b = self.hashes, self.bounds
        counts = np.diff(b)
        if n == 1:
            return h, b
        m = max(len(h) - n + 1, 0)
        grams = np.zeros(m, U)
        for k in range(n):
            grams += h[k : k + m] * STEPS[k]
        inside = np.ones(m, bool)
        for edge in range(1, n):  # starts whose n-gram would cross into the next row
            at = b[1:] - edge
            at = at[(at >= 0) & (at < m)]
            inside[at] = False
        grams = mix(grams[inside])
        have = np.maximum(counts - n + 1, 0)
        out = np.zeros(len(b), np.int64)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if not len(short):
            np.cumsum(have, out=out[1:])
            return grams, out
        own = have.copy()
        own[short] = 1
        np.cumsum(own, out=out[1:])
        full = np.empty(out[-1], U)
        is_short = np.zeros(out[-1], bool)
        is_short[out[short]] = True
        full[~is_short] = grams
        full[out[short]] = [int(mix(np.array([sum(int(h[b[r] + k]) * int(STEPS[k]) for k in range(counts[r])) % 2**64 ^ int(counts[r])], dtype=U))[0]) for r in short]
        return full, out


_powers = powers(1, _BASE)
_inverses = powers(1, _INVERSE)


def int64_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))
