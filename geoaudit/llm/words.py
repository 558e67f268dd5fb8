"""Words and their hashes, taken from Arrow string columns with numpy, without Python strings.

All functions work on the UTF-8 bytes of a run of texts. Lower-casing touches A-Z only, and every word
class here is a set of bytes, so multi-byte characters are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Runs of anything but white space.
NON_SPACE = ~_SPACE
#: Runs of digits, letters and all that is not ASCII (after lower-casing).
WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers = {_BASE: np.ones(1, dtype=np.uint64), _BASE_INVERSE: np.ones(1, dtype=np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers[base]
    if len(known) < n:
        factors = np.full(-(-n // (1 << 18)) << 18, base, dtype=np.uint64)
        factors[0] = 1
        known = _powers[base] = np.multiply.accumulate(factors)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """The words of a run of texts, in order."""

    data: np.ndarray  #: the texts' bytes, lower-cased unless that was not asked for
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    doc: np.ndarray  #: which text the word is in
    first: np.ndarray  #: first word of each text, and the number of all words


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole texts of about ``limit`` bytes: first row, end row, bytes, offsets."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def split(data: np.ndarray, at: np.ndarray, kind: np.ndarray = NON_SPACE, lower: bool = True) -> Words:
    """Lower-case A-Z and find the words: the longest runs of bytes of ``kind`` within a text."""
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    start, end = edge[:-1].copy(), edge[1:].copy()
    start[1:] |= ~inside[:-1]
    end[:-1] |= ~inside[1:]
    start, end = np.flatnonzero(start & inside), np.flatnonzero(end & inside) + 1
    first = np.searchsorted(start, at)
    return Words(data, start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, independent of where the word stands."""
    n = len(words.data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
    back = _power(_BASE_INVERSE, n + 1)
    return mix((total[words.end] - total[words.start]) * back[words.start] + (words.end - words.start).astype(np.uint64))


def _order(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, in order, and where each text's begin.

    A text with fewer words, but not none, has one: the whole sequence.
    """
    hashes, counts = word_hashes(words), np.diff(words.first)
    n, factor = max(0, len(hashes) - size + 1), _order(size)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * factor[k]
    whole = words.doc[:n] == words.doc[size - 1 :] if n else np.zeros(0, dtype=bool)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(first[-1], dtype=np.uint64)
    long = np.repeat(counts >= size, made)
    out[long] = total[whole]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[words.first[d] : words.first[d + 1]]
        out[first[d]] = np.sum(own * factor[: len(own)], dtype=np.uint64) + np.uint64(len(own))
    return mix(out), first
