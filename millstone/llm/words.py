"""Words, word hashes and windows of whole texts, computed on Arrow buffers with numpy.

Texts are treated as UTF-8 bytes. A-Z are lower-cased; a word is a longest run of the
bytes that a table admits, so both word definitions used here (anything but ASCII white
space; ASCII letters, digits and every non-ASCII character) are exact on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from millstone.llm.shared import offsets_of, slices

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of a run of rows. ``first`` has, per row and one more, the index of its first word."""

    rows: range
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    texts: np.ndarray

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b, blank-separated."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))


def words_of(column: pa.Array, admitted: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of every row of a string column, a bounded number of bytes at a time. A null row has none."""
    if column.null_count and np.diff(offsets_of(column))[column.is_null().to_numpy(zero_copy_only=False)].any():
        # Nulls are as good as empty unless there are bytes below them.
        column = column.fill_null("")
    for a, b in slices(column, most):
        yield _words(column, a, b, admitted)


def _words(column: pa.Array, a: int, b: int, admitted: np.ndarray) -> Words:
    at = offsets_of(column)[a : b + 1]
    values = column.buffers()[2]
    whole = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    data = LOWER[whole[at[0] : at[-1]]]
    at = at - at[0]
    inside = admitted[data]
    n = len(data)
    begins = inside.copy()
    stops = inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = inside[edge]
        stops[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, at)
    if len(starts):
        lens = ends - starts
        run = np.concatenate(([0], np.cumsum(lens)))
        where = np.arange(run[-1]) - np.repeat(run[:-1], lens)
        terms = (data[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[where]
        hashes = mixed(np.add.reduceat(terms, run[:-1]) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    return Words(range(a, b), data, starts, ends, hashes, first, at)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each position on; positions with fewer words left are dropped."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= _BASE
        total += hashes[j : j + n]
    return mixed(total + np.uint64(k))
