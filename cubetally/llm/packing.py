"""Packing: hierarchical multi-length packing of documents into training sequences.

Method: windows have several context sizes (TIERS, powers of two).  A document gives whole windows of the
largest size, and its remainder is routed to the smallest tier that holds it.  Tiers are packed from the
longest to the shortest: a window starts with a remainder of its own tier, its gap takes the longest
remainders of shorter tiers that fit, and the last gap takes a cut of the shortest piece left, so that a
window is full (a full window is a power of two and so needs no padding).  Windows are then dealt to step
groups of about STEP_TOKENS tokens, the longest first, always to the group with the fewest tokens.

Each partition packs for itself, in pools of POOL_TOKENS; what does not fill a window moves to the next
pool, and only the last window of a partition can be short.  No shuffle; a task's memory is one pool.

Cases: null text is an empty document (its end id alone); repeated rows are packed once each; null doc_id
is kept; an empty table gives no pieces; a document longer than a pool is a pool of its own; other columns
of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cubetally.llm.arrowtext import releasing
from cubetally.llm.tokens import crc_ids, default_path, encoder

TIERS = (2048, 1024, 512, 256)
POOL_TOKENS = 2_000_000
STEP_TOKENS = 64 * 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pool:
    """Remainders by length; ``take`` finds the longest that fits in O(1) big-integer steps."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.mask = 0

    def put(self, piece: tuple[int, int, int]) -> None:
        self.by_length.setdefault(piece[2], []).append(piece)
        self.mask |= 1 << piece[2]

    def take(self, length: int) -> tuple[int, int, int]:
        have = self.by_length[length]
        piece = have.pop()
        if not have:
            self.mask &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1 if self.mask else 0


def pack(lengths: list[int], carried: list[tuple[int, int, int]], last: bool) -> tuple[list[tuple[int, list]], list]:
    """(windows, left over): a window is (tier, pieces), a piece (document, start, length).

    ``carried`` are pieces of earlier pools.  Unless ``last``, pieces that do not fill a window are left over.
    """
    longest = TIERS[0]
    windows: list[tuple[int, list]] = []
    pool = Pool()
    for piece in carried:
        pool.put(piece)
    for d, n in enumerate(lengths):
        whole = n // longest * longest
        windows += [(longest, [(d, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            pool.put((d, whole, n - whole))
    for tier, shorter in zip(TIERS, (*TIERS[1:], 0), strict=True):
        while (first := pool.longest(tier)) > shorter:
            window, gap = [pool.take(first)], tier - first
            while gap and pool.mask:
                n = pool.longest(gap)
                if n:
                    window.append(pool.take(n))
                    gap -= n
                else:  # every piece left is longer than the gap
                    d, at, size = pool.take(pool.shortest())
                    window.append((d, at, gap))
                    pool.put((d, at + gap, size - gap))
                    gap = 0
            if gap and not last:
                return windows, window
            windows.append((tier, window))
    return windows, []


def step_groups(windows: list[tuple[int, list]]) -> list[int]:
    """Group of each window: the longest first, to the group with the fewest tokens so far."""
    size = [sum(p[2] for p in w) for _, w in windows]
    groups = [(0, g) for g in range(max(1, round(sum(size) / STEP_TOKENS)))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-size[i], i)):
        total, g = groups[0]
        heapq.heapreplace(groups, (total + size[i], g))
        out[i] = g
    return out


def packed_batches(batches: Iterator[pa.RecordBatch], path: str, kind: str, end_id: int, partition: int) -> Iterator[pa.RecordBatch]:
    """Pieces of all documents of one partition; columns doc_id and text in."""
    enc = encoder(path, kind)
    docs: list[tuple[object, np.ndarray]] = []  # (doc_id, ids) of this pool; pieces name them by position
    carried: list[tuple[int, int, int]] = []
    n_sequences = n_groups = 0

    def flush(fresh: int, last: bool) -> pa.RecordBatch:
        nonlocal docs, carried, n_sequences, n_groups
        lengths = [0] * fresh + [len(ids) for _, ids in docs[fresh:]]
        windows, left = pack(lengths, carried, last)
        groups = step_groups(windows)
        rows = []
        for w, (tier, pieces) in enumerate(windows):
            at = 0
            for d, start, n in pieces:
                doc_id, ids = docs[d]
                rows.append((doc_id, start, n, crc_ids(ids[start : start + n]), len(ids), (partition << 32) + n_sequences + w, at, tier, (partition << 32) + n_groups + groups[w]))
                at += n
        n_sequences += len(windows)
        n_groups += max(groups, default=-1) + 1
        keep = sorted({d for d, _, _ in left})
        at = {d: i for i, d in enumerate(keep)}
        docs, carried = [docs[d] for d in keep], [(at[d], start, n) for d, start, n in left]
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    fresh = tokens = 0
    for b in batches:
        names = b.column(0).to_pylist()
        for first, ids, bounds in enc.encode(b.column(1), end_id):
            for r in range(len(bounds) - 1):
                docs.append((names[first + r], ids[bounds[r] : bounds[r + 1]]))
            tokens += len(ids)
            if tokens >= POOL_TOKENS:
                yield flush(fresh, False)
                fresh, tokens = len(docs), 0
    yield flush(fresh, True)


def packed(documents: DataFrame, path: str | None = None, kind: str = "word", end_id: int = 1) -> DataFrame:
    """One row per piece of ``documents``, with its place in a sequence, tier and step group."""
    path = path or default_path("word_bpe_49k.json")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed_batches(batches, path, kind, end_id, TaskContext.get().partitionId())

    return documents.select("doc_id", "text").mapInArrow(releasing(task), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
