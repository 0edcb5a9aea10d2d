"""Hashed character n-gram features over Arrow text batches (numpy, no per-row Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cubetally.llm.arrowtext import _WORD, first_flags, slices

_MULTIPLIERS = [np.uint64(2 * m + 1) for m in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x3C6EF372FE94F82B, 0x106689D45497FDB5, 0x7FB5D329728EA185)]


def characters(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets counted in code points) of UTF-8 bytes; A-Z are kept."""
    if len(raw) and raw.max() >= 128:
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        if len(points) == lead[-1]:
            return points, lead[offs]
    return raw.astype(np.uint32), offs


def fold(points: np.ndarray) -> np.ndarray:
    """ASCII capitals to small letters."""
    return np.where((points >= 65) & (points <= 90), points + 32, points)


def ngrams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n characters from each position on (the last n-1 positions have none)."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    wide = points.astype(np.uint64)
    h = wide[:m] * _MULTIPLIERS[0]
    for j in range(1, n):
        h += wide[j : j + m] * _MULTIPLIERS[j]
    h += np.uint64(n * 0x632BE5AB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def row_ngrams(points: np.ndarray, offs: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (buckets by position, mask of positions whose n-gram stays inside its row)."""
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(points))  # characters from here to the row's end
    for n in orders:
        b = ngrams(points, n, bits)
        yield b, left[: len(b)] >= n


def sparse_rows(column: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct buckets) for each row."""
    for first, to, raw, offs in slices(column, 1 << 20):
        points, at = characters(raw, offs)
        points = fold(points)
        rows = np.repeat(np.arange(to - first), np.diff(at))
        keys = [(rows[: len(b)][ok] << bits) | b[ok] for b, ok in row_ngrams(points, at, orders, bits)]
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        cut = np.searchsorted(keys, np.arange(to - first + 1) << bits)
        for r in range(to - first):
            yield first + r, keys[cut[r] : cut[r + 1]] & ((1 << bits) - 1)


def whitespace_points(points: np.ndarray) -> np.ndarray:
    """True at ASCII white space."""
    out = np.zeros(len(points), bool)
    small = points < 256
    out[small] = ~_WORD[points[small]]
    return out


def word_features(points: np.ndarray, offs: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows): each white-space word, and each character n-gram of "<word>", hashed to buckets."""
    n = len(points)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    space = whitespace_points(points)
    marked = np.where(space, np.uint32(32), points)
    first = first_flags(n, offs)
    begin = ~space
    begin[1:] &= space[:-1] | first[1:]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.where(space, 0, points).astype(np.uint64)
    from cubetally.llm.arrowtext import mix64, powers

    h = np.add.reduceat((wide * _MULTIPLIERS[0] ^ (wide << np.uint64(33))) * powers(n), starts) * powers(n, True)[starts]
    out, who = [(mix64(h) >> np.uint64(64 - bits)).astype(np.int64)], [rows[starts]]
    inner = np.zeros(n + 1, np.int64)
    np.cumsum(space, out=inner[1:])
    for (b, ok), k in zip(row_ngrams(marked, offs, orders, bits), orders, strict=True):
        m = len(b)
        if m:
            ok = ok & (inner[k - 1 : k - 1 + m] == inner[1 : 1 + m])  # white space may only be the first or last character
            out.append(b[ok])
            who.append(rows[:m][ok])
    return np.concatenate(out), np.concatenate(who)
