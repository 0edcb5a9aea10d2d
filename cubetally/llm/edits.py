"""Token counts that follow edits: segment trees over pre-token pieces.

Method: a document is cut into pieces where its tokenizer always cuts; LEAF pieces in a row are a leaf, and a
segment tree keeps bytes, code points and tokens of each subtree.  An edit finds its leaves by descending on code
points, takes whole leaves around it until CONTEXT unchanged bytes, and as many as the longest added token has, stand
between the edit and the region's ends (a cut depends on no byte further away, so the ends stay cuts), encodes that
region only, writes the new pieces into the same leaves and updates the sums on their paths.  A leaf's text is a
stretch of the text that the tree was built of, or its own once edited, so an edit costs its region and the paths'
length, not the document's.  When a region outgrows its leaves by more than twice, the leaves are dealt again (sums
only, nothing is encoded).  A count after an edit is the root's sum.

Trees can be stored (``trees``) and taken up again: ``edited_counts`` and ``edited_trees`` use the stored tree of a
document, if its text is still the one that the tree was built of, and encode nothing but the edits' regions.

Cases: null or empty text has a tree of one empty leaf; edit positions are code points of the text as the
earlier edits of its list left it and are clipped to the text; null or empty edit lists change nothing; null
fields of an edit count as 0 or empty; repeated rows are counted once each; an empty table gives an empty
result; a stored tree that is missing, of another text or stored twice does not change a count; ``trees``,
``edited_counts`` and ``edited_trees`` read doc_id, text and edits only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.llm.arrowtext import releasing
from cubetally.llm.tokens import PieceEncoder, default_path, encoder

LEAF = 16
CONTEXT = 4
BYTES, POINTS, TOKENS = range(3)


def points_in(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) if raw.isascii() else int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


class Tree:
    """Sums of bytes, code points and tokens over leaves; node 1 is the root, leaf i is node size + i."""

    __slots__ = ("size", "leaves", "sums", "raw", "at", "own")

    def __init__(self, raw: bytes, leaf_sums: np.ndarray):
        """``leaf_sums``: a row each of bytes, code points and tokens of the stretches of ``raw`` that are leaves."""
        self.raw, self.own = raw, {}
        self.at = np.append(0, np.cumsum(leaf_sums[BYTES]))
        self._sum_up(leaf_sums)

    def _sum_up(self, leaf_sums: np.ndarray) -> None:
        n = leaf_sums.shape[1]
        self.leaves = max(1, n)
        self.size = 1 << (self.leaves - 1).bit_length()
        self.sums = np.zeros((3, 2 * self.size), np.int64)
        self.sums[:, self.size : self.size + n] = leaf_sums
        at = self.size
        while at > 1:
            self.sums[:, at // 2 : at] = self.sums[:, at : 2 * at].reshape(3, -1, 2).sum(2)
            at //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[TOKENS, 1])

    @property
    def bytes(self) -> int:
        return int(self.sums[BYTES, 1])

    def leaf_sums(self) -> np.ndarray:
        return self.sums[:, self.size : self.size + self.leaves]

    def leaf_text(self, leaf: int) -> bytes:
        own = self.own.get(leaf)
        if own is None:
            return self.raw[self.at[leaf] : self.at[leaf + 1]] if leaf + 1 < len(self.at) else b""
        return own

    def text(self) -> bytes:
        return b"".join(map(self.leaf_text, range(self.leaves))) if self.own else self.raw

    def find(self, point: int) -> tuple[int, int]:
        """(leaf that holds a code point, its byte in the leaf); the text's end lies in the last leaf with text."""
        point = min(max(0, point), int(self.sums[POINTS, 1]))
        node = 1
        while node < self.size:
            node *= 2
            here = int(self.sums[POINTS, node])
            if point >= here and self.sums[POINTS, node + 1]:
                point -= here
                node += 1
        leaf = min(node - self.size, self.leaves - 1)
        text = self.leaf_text(leaf)
        return leaf, point if text.isascii() else len(text.decode()[:point].encode())

    def put(self, leaf: int, text: bytes, n_tokens: int) -> None:
        self.own[leaf] = text
        node = self.size + leaf
        path = [node >> k for k in range(node.bit_length())]
        self.sums[:, path] += (np.array([len(text), points_in(text), n_tokens]) - self.sums[:, node])[:, None]

    def deal_again(self, left: int, right: int, texts: list[bytes], tokens: list[int]) -> None:
        """Leaves ``left`` to ``right`` give way to as many as ``texts`` has; the others keep their sums."""
        new = np.array([[len(t) for t in texts], [points_in(t) for t in texts], tokens], np.int64)
        old = self.leaf_sums()
        sums = np.concatenate([old[:, :left], new, old[:, right + 1 :]], axis=1)
        kept = [*map(self.leaf_text, range(left)), *texts, *map(self.leaf_text, range(right + 1, self.leaves))]
        self.raw, self.own = b"".join(kept), {}
        self.at = np.append(0, np.cumsum(sums[BYTES]))
        self._sum_up(sums)


def counts_of(enc: PieceEncoder, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts, tokens) of the pieces of one stretch of text."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = enc.starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    ends = [*starts[1:].tolist(), len(raw)]
    return starts, enc.count_few([raw[a:b].decode() for a, b in zip(starts.tolist(), ends, strict=True)])


def apply_edit(enc: PieceEncoder, tree: Tree, start: int, removed: int, added: str) -> int:
    """Bytes encoded: ``removed`` code points from ``start`` on give way to ``added``."""
    new = added.encode("utf-8", "replace")
    context = CONTEXT + enc.reach
    (left, before), (right, b) = tree.find(start), tree.find(start + removed)
    after = int(tree.sums[BYTES, tree.size + right]) - b
    while left > 0 and before < context:
        left -= 1
        before += int(tree.sums[BYTES, tree.size + left])
    while right < tree.leaves - 1 and after < context:
        right += 1
        after += int(tree.sums[BYTES, tree.size + right])
    old = b"".join(map(tree.leaf_text, range(left, right + 1)))
    region = old[:before] + new + old[len(old) - after :]
    starts, tokens = counts_of(enc, region)
    leaves = right - left + 1
    grown = len(starts) > 2 * LEAF * leaves
    if grown:
        leaves = -(-len(starts) // LEAF)
    cut = np.arange(leaves + 1) * len(starts) // leaves
    edges, upto = np.append(starts, len(region)), np.append(0, np.cumsum(tokens))
    texts = [region[edges[cut[i]] : edges[cut[i + 1]]] for i in range(leaves)]
    sizes = np.diff(upto[cut]).tolist()
    if grown:
        tree.deal_again(left, right, texts, sizes)
    else:
        for i in range(leaves):
            tree.put(left + i, texts[i], sizes[i])
    return len(region)


def built(enc: PieceEncoder, column: pa.Array) -> Iterator[tuple[int, Tree]]:
    """(row, tree) of each row."""
    for first, raw, starts, piece_row, at in enc.pieces(column):
        edges = np.append(starts, len(raw))
        points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[edges]
        upto = np.stack([edges, points, np.append(0, np.cumsum(enc.counts(at)))])
        for r in range(len(piece_row) - 1):
            p, q = piece_row[r], piece_row[r + 1]
            marks = np.append(np.arange(p, q, LEAF), q)
            yield first + r, Tree(raw[edges[p] : edges[q]].tobytes(), np.diff(upto[:, marks], axis=1))


def taken_up(raw: bytes, leaf_bytes: np.ndarray, leaf_tokens: np.ndarray) -> Tree:
    """A stored tree over its text; code points are counted, nothing is encoded."""
    at = np.append(0, np.cumsum(leaf_bytes, dtype=np.int64))
    points = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))[at]
    return Tree(raw, np.stack([leaf_bytes, np.diff(points), leaf_tokens]).astype(np.int64))


def hash_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


STORED = "doc_id long, text_hash long, n_tokens long, leaf_bytes array<int>, leaf_tokens array<int>"


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def leaves_of(got: list[Tree]) -> list[pa.Array]:
    return [pa.array([t.leaf_sums()[k].astype(np.int32) for t in got], pa.list_(pa.int32())) for k in (BYTES, TOKENS)]


def trees(documents: DataFrame, path: str | None = None, kind: str = "byte") -> DataFrame:
    """STORED: the stored form of each document's tree; inner sums follow from the leaves'."""
    path = path or default_path("byte_bpe_50k.json")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        for b in batches:
            got = [t for _, t in built(enc, b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([t.tokens for t in got], pa.int64()), *leaves_of(got)], names_of(STORED))

    return documents.select("doc_id", "text", hash_of("text").alias("text_hash")).mapInArrow(releasing(task), STORED)


COUNTS = "doc_id long, n_tokens long, n_leaves long, n_edits long, n_tokens_edited long, bytes_edited long, bytes_encoded_again long"
EDITED = f"{COUNTS}, bytes_built long"
AFTER = "doc_id long, text string, n_tokens long, leaf_bytes array<int>, leaf_tokens array<int>"


def with_stored(documents: DataFrame, stored: DataFrame | None) -> DataFrame:
    """doc_id, text, edits, leaf_bytes, leaf_tokens: the leaves are null where no tree of this very text is stored."""
    docs = documents.select("doc_id", "text", "edits")
    if stored is None:
        return docs.withColumns({c: F.lit(None).cast("array<int>") for c in ("leaf_bytes", "leaf_tokens")})
    kept = stored.select("doc_id", "text_hash", "leaf_bytes", "leaf_tokens").dropDuplicates(["doc_id", "text_hash"])
    return docs.withColumn("text_hash", hash_of("text")).join(kept, ["doc_id", "text_hash"], "left").drop("text_hash")


def _edited(documents: DataFrame, path: str | None, kind: str, stored: DataFrame | None, counts: bool) -> DataFrame:
    path = path or default_path("byte_bpe_50k.json")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        for b in batches:
            lists, rows, got = b.column(2).to_pylist(), [], []
            known = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            fresh = built(enc, b.column(1).filter(pa.array(~known)))
            for r, edits in enumerate(lists):
                if known[r]:
                    raw = (b.column(1)[r].as_py() or "").encode()
                    tree = taken_up(raw, b.column(3)[r].values.to_numpy(), b.column(4)[r].values.to_numpy())
                else:
                    tree = next(fresh)[1]
                first, again, n = (tree.tokens, tree.leaves, tree.bytes), 0, len(edits or [])
                for e in edits or []:
                    if e is not None:
                        again += apply_edit(enc, tree, e["start"] or 0, max(0, e["removed"] or 0), e["added"] or "")
                if counts:
                    rows.append((first[0], first[1], n, tree.tokens, tree.bytes, again, 0 if known[r] else first[2]))
                else:
                    rows.append((tree.text().decode(), tree.tokens))
                    got.append(tree)
            columns = list(zip(*rows, strict=True)) or [[]] * (7 if counts else 2)
            if counts:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in columns]], names_of(EDITED))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), *leaves_of(got)], names_of(AFTER))

    return with_stored(documents, stored).mapInArrow(releasing(task), EDITED if counts else AFTER)


def edited_counts(documents: DataFrame, path: str | None = None, kind: str = "byte", stored: DataFrame | None = None) -> DataFrame:
    """Counts before and after each document's ``edits`` (array of struct start, removed, added); bytes_built were encoded for want of a stored tree."""
    return _edited(documents, path, kind, stored, True)


def edited_trees(documents: DataFrame, path: str | None = None, kind: str = "byte", stored: DataFrame | None = None) -> DataFrame:
    """doc_id, text and STORED's columns after the edits: what ``trees`` and a later call's documents would hold."""
    return _edited(documents, path, kind, stored, False).select("doc_id", "text", hash_of("text").alias("text_hash"), "n_tokens", "leaf_bytes", "leaf_tokens")


def standing_edits(documents: DataFrame) -> DataFrame:
    """``documents`` with three edits each: an insertion, a deletion and a replacement at fixed shares of the text."""
    n = F.coalesce(F.length("text"), F.lit(0))
    at = lambda share, removed, added: F.struct((n * share / 8).cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), F.lit(added).alias("added"))
    return documents.withColumn("edits", F.array(at(2, 0, " inserted words, here"), at(4, 24, ""), at(6, 5, "\nReplacedé")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(standing_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
