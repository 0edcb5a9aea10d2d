"""Large components, clashing column names, piece tables that overflow, and what the range coder saves."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cubetally.llm import binary, jaccard, rangecoder, topk, toxicity
from cubetally.llm.tokens import PieceEncoder, PieceTable, default_path


def test_top_k_of_scores_past_two_to_the_53(spark):
    values = np.random.default_rng(1).normal(0, 3e5, (120, 16)).astype(np.float64)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(1024 * x)) for x in v] for v in values]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(rows, F.col("vec_id") % 10 == 0, 5).collect())
    want = []
    for q in range(0, 120, 10):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(120) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def test_filters_keep_columns_of_any_name(spark):
    rows = [(i, "some plain words that stand in text number %d" % i, -5.0, 7, "g") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted long, gone string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows


def test_copies_hang_together_through_parts(spark):
    rows = [(i, 1, 2, 3) for i in range(300)] + [(1000, 5, 2, 3), (1001, 5, 2, 3), (1001, 5, 2, 3), (2000, 6, 6, 6)]
    links = jaccard.copy_links(spark.createDataFrame(rows, "doc_id long, fp1 long, fp2 long, n_shingles long")).collect()
    assert sorted(r["u"] for r in links) == [*range(1, 300), 1001]
    least = {r["u"]: r["v"] for r in links}
    for i in range(1, 300):
        at = i
        while at:
            at = least[at]
    assert least[1001] == 1000


def test_small_piece_table_gives_the_same_ids():
    texts = [f"word{i} café {chr(97 + i % 26) * (i % 9)} домİ Σς n{i}o, x<|endoftext|>y" for i in range(400)]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        enc, fresh = PieceEncoder(default_path(name), kind, cache=50), Tokenizer.from_file(default_path(name))
        for _ in range(2):
            for k in range(0, 400, 20):
                got = [ids[b[r] : b[r + 1]].tolist() for _, ids, b in enc.encode(pa.array(texts[k : k + 20])) for r in range(len(b) - 1)]
                assert got == [e.ids for e in fresh.encode_batch(texts[k : k + 20], add_special_tokens=False)]


def test_piece_table_keeps_what_was_used_last():
    table = PieceTable(8)
    h = np.arange(1, 9, dtype=np.uint64) << np.uint64(50)
    table.add(h, h, np.arange(8, dtype=np.uint32), np.ones(8, np.int64))
    table.find(h[4:], h[4:])
    assert table.make_room(2)
    assert (table.find(h[4:], h[4:]) >= 0).all() and (table.find(h[:4], h[:4]) < 0).all()
    entry = table.find(h[4:], h[4:])
    assert table.grown["pool"][table.grown["first"][entry]].tolist() == [4, 5, 6, 7]
    assert (table.find(h[4:], h[4:] + np.uint64(1)) < 0).all()  # a twin in one hash alone


def test_range_coder_beats_zlib_and_order_0(sf):
    import duckdb

    texts = duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' ORDER BY doc_id").arrow().read_all()["text"].combine_chunks()
    enc = PieceEncoder(default_path("byte_bpe_50k.json"), "byte")
    ids = np.concatenate([x for _, x, _ in enc.encode(texts, 2)])
    codes = rangecoder.encode_blocks(ids, 2048, False)
    assert (rangecoder.decode_blocks(codes, len(ids), 2048, False) == ids).all()
    parts = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
    size = sum(map(len, codes))
    assert size < 0.9 * sum(len(zlib.compress(p.astype("<u2").tobytes(), 9)) for p in parts)
    bits = 0.0
    for p in parts:  # counts of the block so far; a new id takes the share of the different ids seen and 16 bits
        seen: dict[int, int] = {}
        for n, x in enumerate(p.tolist()):
            share = seen[x] if x in seen else max(1, len(seen))
            bits += np.log2(max(1, n + len(seen)) / share) + (0 if x in seen else 16)
            seen[x] = seen.get(x, 0) + 1
    assert size < bits / 8


def test_range_coder_round_trips():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(5000, np.int64), rng.integers(0, 1 << 16, 4100), rng.integers(0, 1 << 32, 3000), np.arange(70), np.tile([1, 2, 3, 1, 2, 4], 900), rng.geometric(0.05, 9000)):
        wide = int(ids.max()) >= 1 << 16
        codes = rangecoder.encode_blocks(ids, 2048, wide)
        assert (rangecoder.decode_blocks(codes, len(ids), 2048, wide) == ids).all()


def test_sections_cut_a_shard_and_take_small_rests(spark, sf, tmp_path):
    path = default_path("byte_bpe_50k.json")
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plain, at, wanted = Tokenizer.from_file(path), 0, []
    for row in documents.orderBy("doc_id").collect():
        ids = [*plain.encode(row.text or "", add_special_tokens=False).ids, 2]
        wanted.append((row.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    sizes = {}
    for least in (20_000, 1 << 40):
        target = f"file://{tmp_path}/{least}"
        binary.write_tokens(documents, target, path, shards=1, section_tokens=least)
        rows = binary.read_tokens(spark, target).orderBy("doc_id").collect()
        assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == wanted
        sizes[least] = [r.n_ids for r in spark.read.parquet(target).orderBy("section").collect()]
    assert len(sizes[20_000]) > 1 and min(sizes[20_000][:-1]) >= 20_000 and sizes[20_000][-1] >= 10_000
    assert sizes[1 << 40] == [at]
