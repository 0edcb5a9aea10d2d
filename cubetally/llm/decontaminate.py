"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item of n shingles (SHINGLE words each) is contained in a document when the document has at least
THRESHOLD of them.  A short item's Jaccard similarity to a long document is tiny, so both sides are
partitioned by size: items by the power of two L above n (L/2 <= n < L), documents, for each such class, into
cells of L shingles in text order.  Each item and each cell gets a one-permutation MinHash: 2 * L bins by
hash, the least hash of each bin.  An item and a document with an equal minimum in a bin are candidates, and
the exact containment over the whole document decides.  A shared shingle is displaced from its bin in a cell
with a chance near 1/5, and a miss needs all shared minima to be displaced: about 1/5 to the power of their number.

Items of fewer than SMALL shingles have too few minima for that and are searched without loss: a document with
k of an item's n shingles has one of any n - k + 1 of them, so that many of each item (those in the fewest items)
are indexed themselves, and every document shingle is looked up.

The items of one block (BLOCK_SHINGLES shingles at most, or one item) are broadcast; a larger benchmark is
searched in several blocks.  Documents stream through one map stage a block, with no shuffle.

Cases: null or empty texts have no shingles and match nothing; a text of fewer than SHINGLE words is one
shingle of all its words; rows that repeat are reported once each, items with the same id and text once;
an empty benchmark gives an empty result; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.llm.arrowtext import mix64, releasing, SHINGLE, shingle_hashes, shingle_sets, slices, word_hashes

THRESHOLD = (75, 100)
BLOCK_SHINGLES = 1_000_000
SMALL = 32
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


class Items:
    """Shingle sets of one block of test items, with the MinHash index by size class and the shingle index of small items."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        by_class: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        small = [i for i, s in enumerate(sets) if 0 < len(s) < SMALL]
        for i, s in enumerate(sets):
            if len(s) >= SMALL:
                size = 1 << int(len(s)).bit_length()
                by_class.setdefault(size, []).append((minima(s, np.zeros(len(s), np.int64), size)[1], i))
        #: size class -> (sorted minima, item of each)
        self.index = {}
        for size, found in by_class.items():
            values = np.concatenate([m for m, _ in found])
            owner = np.repeat([i for _, i in found], [len(m) for m, _ in found])
            order = np.argsort(values, kind="stable")
            self.index[size] = values[order], owner[order]
        #: (sorted shingles, item of each), enough of each small item that no document with THRESHOLD of it lacks them all
        self.shingles = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if small:
            every, uses = np.unique(np.concatenate([sets[i] for i in small]), return_counts=True)
            num, den = THRESHOLD
            found = []
            for i in small:
                s = sets[i]
                rare = np.argsort(uses[np.searchsorted(every, s)], kind="stable")
                found.append(s[rare[: len(s) + (-num * len(s)) // den + 1]])
            values, owner = np.concatenate(found), np.repeat(small, [len(f) for f in found])
            order = np.argsort(values, kind="stable")
            self.shingles = values[order], owner[order]


def minima(hashes: np.ndarray, cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, least hash) of each used bin; the bin is the hash's top bits, so sorting by hash sorts by bin."""
    shift = np.uint64(64 - int(size).bit_length())  # 2 * size bins
    mixed = mix64(hashes)
    order = np.lexsort((mixed, cells)) if len(cells) and cells[-1] else np.argsort(mixed, kind="stable")
    c, m = cells[order], mixed[order]
    bins = m >> shift
    first = np.ones(len(m), bool)
    first[1:] = (c[1:] != c[:-1]) | (bins[1:] != bins[:-1])
    return c[first], m[first]


def cell_minima_in(hashes: np.ndarray, at: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, minimum) of the minima of all cells that are in ``known`` (sorted).

    Whether a hash is the least of its bin matters only if the hash is an item's minimum, so the cells with such
    a hash are found first and only they are sorted.
    """
    mixed = mix64(hashes)
    place = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
    hit = known[place] == mixed
    if not hit.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    cell = (np.arange(len(hashes)) - at[row]) // size
    label = np.cumsum(np.concatenate([[0], ((row[1:] != row[:-1]) | (cell[1:] != cell[:-1])).astype(np.int64)]))
    wanted = np.zeros(label[-1] + 1, bool)
    wanted[label[hit]] = True
    some = np.flatnonzero(wanted[label])
    of_label = np.zeros(label[-1] + 1, np.int64)
    of_label[label[some]] = row[some]
    c, m = minima(hashes[some], label[some], size)
    place = np.minimum(np.searchsorted(known, m), len(known) - 1)
    ok = known[place] == m
    return of_label[c[ok]], m[ok]


def shingles_in(hashes: np.ndarray, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every shingle that is in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
    return np.searchsorted(at, hit, "right") - 1, hashes[hit]


def contained(column: pa.Array, items: Items) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of each contained item."""
    num, den = THRESHOLD
    for first, _, raw, offs in slices(column):
        words, _, bounds = word_hashes(raw, offs)
        hashes, at = shingle_hashes(words, bounds)
        if not len(hashes):
            continue
        pairs: set[tuple[int, int]] = set()
        found = [(*items.shingles, *shingles_in(hashes, at, items.shingles[0]))]
        found += [(values, owner, *cell_minima_in(hashes, at, size, values)) for size, (values, owner) in items.index.items()]
        for values, owner, rows, m in found:
            lo, hi = np.searchsorted(values, m, "left"), np.searchsorted(values, m, "right")
            pairs.update((int(r), int(owner[k])) for r, p, q in zip(rows, lo, hi, strict=True) for k in range(p, q))
        own: dict[int, np.ndarray] = {}
        for r, i in sorted(pairs):
            if r not in own:
                own[r] = np.unique(hashes[at[r] : at[r + 1]])
            s = items.sets[i]
            where = np.minimum(np.searchsorted(own[r], s), len(own[r]) - 1)
            shared = int((own[r][where] == s).sum())
            if shared * den >= num * len(s):
                yield first + r, i, shared


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The test items in blocks of bounded size; by item hash, so that no block depends on row order."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * BLOCK_SHINGLES)))  # a shingle starts with a word, a word has 2 characters at least with its space
    for b in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        got.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield Items([r["item_id"] for r in got], [s for _, s in shingle_sets(pa.array([r["text"] for r in got], pa.string()))])


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of each test item in each document that contains it."""
    spark = documents.sparkSession
    found = None
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                rows = list(contained(b.column(1), items)) if items.sets else []
                names = b.column(0)
                got = [(names[r].as_py(), items.ids[i], len(items.sets[i]), n, n / len(items.sets[i])) for r, i, n in rows]
                columns = list(zip(*got, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

        part = documents.select("doc_id", "text").mapInArrow(releasing(task), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that contain no test item, columns unchanged; decided row by row."""
    spark = documents.sparkSession
    out = documents
    at = documents.columns.index("text")
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                if items.sets:
                    keep[[r for r, _, _ in contained(b.column(at), items)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(releasing(task), documents.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _shingles_sql(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, unnest(CASE
    WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END) AS s
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})"""


ORACLE = f"""
WITH d AS ({_shingles_sql('documents', 'doc_id')}
), i AS ({_shingles_sql('benchmark', 'item_id')}
), sizes AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM shared JOIN sizes USING (item_id)
WHERE 100 * n_shared >= 75 * n_item
"""
