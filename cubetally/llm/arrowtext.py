"""Word, shingle and hash kernels over Arrow string buffers.

The kernels work on the UTF-8 bytes of a whole batch at once: ASCII white space and A-Z are single
bytes in UTF-8, so byte tables give the same words as a code point regex.  Word identity is a 64-bit
hash (random byte table, odd multiplier, splitmix64 finish); a set comparison of two documents can
differ from the word-level one only if two different shingles of that same pair collide, which has a
chance near n * m / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
SHINGLE_SLICE = 1 << 20  # hashing words takes some 40 bytes a byte of text
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_SPACE
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish of the public splitmix64 generator: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int, zero: np.ndarray | None = None, fold: bool = True) -> np.ndarray:
    """256 pseudo-random 64-bit values; A-Z share the values of a-z when fold, ``zero`` bytes give 0."""
    t = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT + np.uint64(seed))
    if fold:
        t[65:91] = t[97:123]
    if zero is not None:
        t[zero] = 0
    return t


_BYTES = byte_table(11, _SPACE)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """MULT**i (or its inverse's powers) modulo 2**64 for i < n; grown on demand and kept."""
    have = _powers[inverse]
    if len(have) < n:
        base = np.full(max(n, 1 << 20), _INVERSE if inverse else _MULT, np.uint64)
        base[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(base)
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes; a longer row stands alone."""
    raw, offs = column_bytes(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def first_flags(n: int, offs: np.ndarray) -> np.ndarray:
    first = np.zeros(n + 1, bool)
    first[offs] = True
    return first[:n]


def word_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where a word begins; words never run over a row's end."""
    word = _WORD[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first_flags(len(raw), offs)[1:]
    return np.flatnonzero(begin)


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, byte start of each word, index of the first word of each row and the total)."""
    starts = word_starts(raw, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(offs), np.int64)
    sums = np.add.reduceat(_BYTES[raw] * powers(len(raw)), starts)
    return mix64(sums * powers(len(raw), True)[starts]), starts, np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k-word runs in text order, bounds by row).  A row of 1 to k-1 words gives one hash of all its words."""
    count = np.diff(bounds)
    out_n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.zeros(len(bounds), np.int64)
    np.cumsum(out_n, out=at[1:])
    pad = np.concatenate([words, np.zeros(k, np.uint64)])
    every = np.zeros(len(words), np.uint64)
    for j in range(k):
        every += pad[j : j + len(words)] * mix64(np.full(1, 101 + j, np.uint64))[0]
    keep = np.zeros(len(words) + 1, np.int32)
    full = count >= k
    np.add.at(keep, bounds[:-1][full], 1)
    np.add.at(keep, bounds[1:][full] - k + 1, -1)
    out = np.zeros(at[-1], np.uint64)
    dest = np.zeros(len(bounds) - 1, bool)
    dest[:] = full
    out[np.repeat(dest, out_n)] = mix64(every[np.cumsum(keep[:-1]) > 0])
    for r in np.flatnonzero((count > 0) & ~full):
        h = np.array([count[r]], np.uint64)
        for w in range(bounds[r], bounds[r + 1]):
            h = mix64(h * _MULT + words[w : w + 1])
        out[at[r]] = h[0]
    return out, at


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row in order."""
    for first, to, raw, offs in slices(column, SHINGLE_SLICE):
        words, _, bounds = word_hashes(raw, offs)
        hashes, at = shingle_hashes(words, bounds, k)
        for r in range(to - first):
            s = np.sort(hashes[at[r] : at[r + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield first + r, s


def release() -> None:
    """Hand freed memory back to the system at the end of a task: workers are reused, and others need it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(task):
    """A mapInArrow function that ends with ``release``."""

    def run(batches):
        yield from task(batches)
        release()

    return run
