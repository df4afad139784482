"""Vectorised word and n-gram hashing of Arrow string columns, for use inside tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D. All functions work on slices of a few MB
of text, so a task's memory does not depend on the batch size; a single text of any length is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 22)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of rows ``lo`` to ``hi`` of a column. ``first[r]`` to ``first[r + 1]`` are row r's words."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def slices(column: pa.Array, lower: bool = False, limit: int = 2 << 20, bare: bool = False) -> Iterator[Words]:
    """The words of a string column, in slices of about ``limit`` bytes; a null counts as empty. ``lower``: ASCII
    letters are lowered. ``bare``: ASCII punctuation parts words as white space does."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        return
    everything = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        data = everything[offsets[lo] : offsets[hi]]
        if lower:
            data = _LOWER[data]
        bounds = offsets[lo : hi + 1] - offsets[lo]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = (_IS_ALNUM if bare else _IS_WORD)[data]
        begin = inside[1:-1] > inside[:-2]
        end = inside[1:-1] > inside[2:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begin[cuts] = inside[1:-1][cuts] > 0
        end[cuts - 1] = inside[1:-1][cuts - 1] > 0
        starts = np.flatnonzero(begin)
        yield Words(lo, hi, data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds))
        lo = hi


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k neighbouring words; entry i is of words i to i + k - 1. Runs that cross
    rows are among them: use ``valid``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += hashes[j : j + n]
    return mix(out)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def valid(first: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie within one row."""
    rows = row_of(first)
    n = len(rows) - k + 1
    return rows[:n] == rows[k - 1 :] if n > 0 else np.zeros(0, bool)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` neighbours."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
