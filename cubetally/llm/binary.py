"""Token-ID output: sections of range-coded blocks, in ascending doc_id order, and their reader.

A section is one binary value that holds whole documents, ``section_tokens`` ids at least (the last one of a shard
may hold less; a rest of under half of that goes into the section before).  Layout, little-endian:

    bytes 0-3    magic "CTR2"
    byte  4      1 if ids may take 32 bits, else 0 (16 bits)
    u32          ids a block
    u64          ids in the section
    u32, u32     documents, bytes of the zlib-compressed document table
    table        doc_id (i64), known (u8, 0 for a null id) and number of ids (u32), each as one array
    u32 arrays   bytes of each block, crc32 of each block's ids
    blocks       24-bit words of the range coder, each block from a fresh model

Sections are stored as rows (shard, section, start, n_ids, payload) of a Parquet data set in the shared folder, so
any file system that Spark reads will do and a lost task is simply run again.  Documents are dealt to shards by
doc_id range (the range bounds are percentiles of all doc_ids); shard and section order is doc_id order.

Cases: null text is an empty document (its end id alone); null doc_id sorts first; rows that repeat an id are
written once each, side by side; an empty table gives no sections and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.llm.arrowtext import releasing
from cubetally.llm.rangecoder import decode_blocks, encode_blocks
from cubetally.llm.shared import new_path
from cubetally.llm.tokens import crc_ids, default_path, encoder

MAGIC = b"CTR2"
HEAD = struct.Struct("<4sBIQII")
BLOCK = 2048
SECTION_TOKENS = 6_000_000
SECTIONS = "shard int, section int, start long, n_ids long, payload binary"


class CorruptBlock(ValueError):
    """A block whose ids do not have the stored checksum."""


def write_section(doc_ids: list, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
    blocks = encode_blocks(ids, block, wide)
    crcs = [crc_ids(ids[i * block : (i + 1) * block]) for i in range(len(blocks))]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + counts.astype("<u4").tobytes())
    head = HEAD.pack(MAGIC, wide, block, len(ids), len(doc_ids), len(table))
    return b"".join([head, table, np.array(list(map(len, blocks)), "<u4").tobytes(), np.array(crcs, "<u4").tobytes(), *blocks])


def read_section(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, number of ids of each, all ids); raises CorruptBlock where a checksum fails."""
    magic, wide, block, n, docs, size = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise CorruptBlock("not a section")
    at = HEAD.size
    table = zlib.decompress(payload[at : at + size])
    at += size
    known = np.frombuffer(table, np.uint8, docs, 8 * docs)
    names = [d if k else None for d, k in zip(np.frombuffer(table, "<i8", docs).tolist(), known, strict=True)]
    counts = np.frombuffer(table, "<u4", docs, 9 * docs).astype(np.int64)
    lanes = -(-n // block)
    sizes, crcs = np.frombuffer(payload, "<u4", lanes, at), np.frombuffer(payload, "<u4", lanes, at + 4 * lanes)
    edges = at + 8 * lanes + np.append(0, np.cumsum(sizes, dtype=np.int64))
    ids = decode_blocks([payload[edges[i] : edges[i + 1]] for i in range(lanes)], n, block, bool(wide))
    ids = ids.astype("<u4")
    for i in range(lanes):
        if crc_ids(ids[i * block : (i + 1) * block]) != crcs[i]:
            raise CorruptBlock(f"block {i}")
    return names, counts, ids


def shard_of(documents: DataFrame, shards: int):
    """Column with the shard of a row: how many of the doc_id percentiles lie below it (null: shard 0)."""
    shares = [i / shards for i in range(1, shards)]
    bounds = documents.agg(F.percentile_approx("doc_id", F.array(*[F.lit(s) for s in shares]), 10_000).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0)
    # a binary search, written as a tree of comparisons: no array is walked for each row
    column = F.col("doc_id")

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.coalesce(F.when(column.isNull(), 0), tree(0, len(bounds)))


def token_rows(documents: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """doc_id, n_ids, ids (packed 16 or 32 bits) of each row; no shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        unit = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            names = b.column(0)
            for first, ids, bounds in enc.encode(b.column(1), end_id):
                data, edges = pa.py_buffer(np.ascontiguousarray(ids, unit)), pa.py_buffer((bounds * int(unit[2])).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, edges, data])
                yield pa.RecordBatch.from_arrays([names.slice(first, len(bounds) - 1), pa.array(np.diff(bounds)), packed], ["doc_id", "n_ids", "ids"])

    return documents.select("doc_id", "text").mapInArrow(releasing(task), "doc_id long, n_ids long, ids binary")


def write_tokens(documents: DataFrame, target: str, path: str, kind: str = "byte", end_id: int = 2, shards: int | None = None, section_tokens: int = SECTION_TOKENS) -> None:
    """Write all documents' ids as sections of ``section_tokens`` ids at least under ``target``."""
    spark = documents.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = token_rows(documents, path, kind, end_id).withColumn("shard", shard_of(documents, shards))
    # the shard is the partition; within it, ties of doc_id are ordered by what is written
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "n_ids", "ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("section", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        names, parts, counts, full, shard, section, start = [], [], [], 0, 0, 0, 0  # the first ``full`` documents fill a section

        def row(to: int) -> pa.RecordBatch:
            nonlocal names, parts, counts, section, start
            ids = np.concatenate(parts[:to])
            out = {"shard": shard, "section": section, "start": start, "n_ids": len(ids), "payload": write_section(names[:to], np.array(counts[:to]), ids)}
            start, section = start + len(ids), section + 1
            names, parts, counts = names[to:], parts[to:], counts[to:]
            return pa.RecordBatch.from_pylist([out], schema)

        for b in batches:
            for doc_id, n, raw, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                shard = s
                data = raw.as_buffer()
                names.append(doc_id)
                counts.append(n)
                parts.append(np.frombuffer(data, "<u2" if data.size == 2 * n else "<u4").astype(np.uint32))
                # looked at every 64 documents, or at once after a long one
                if len(counts) % 64 and n <= 100_000:
                    continue
                if not full:
                    full = len(counts) if sum(counts) >= section_tokens else 0
                elif sum(counts[full:]) >= section_tokens // 2:
                    yield row(full)
                    full = len(counts) if sum(counts) >= section_tokens else 0
        if names:
            yield row(len(names))

    rows.mapInArrow(releasing(task), SECTIONS).write.mode("overwrite").option("compression", "none").parquet(target)


def read_tokens(spark: SparkSession, source: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document under ``source``."""
    sections = spark.read.schema(SECTIONS).parquet(source)
    totals = {r["shard"]: r["n"] for r in sections.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one number a shard
    before, at = {}, 0
    for s in sorted(totals):
        before[s], at = at, at + totals[s]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                names, counts, ids = read_section(b.column(2)[r].as_py())
                edges = np.append(0, np.cumsum(counts))
                start = before[b.column(0)[r].as_py()] + b.column(1)[r].as_py()
                columns = [pa.array(names, pa.int64()), pa.array(start + edges[:-1]), pa.array(counts), pa.array([crc_ids(ids[p:q]) for p, q in zip(edges[:-1], edges[1:], strict=True)], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return sections.select("shard", "start", "payload").mapInArrow(releasing(task), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_path(spark, "token-sections")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), target, default_path("byte_bpe_50k.json"))
    return read_tokens(spark, target)
