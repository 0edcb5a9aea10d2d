"""Token pieces, range coder, sections, packing and edits against plain encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubetally.llm import binary, edits, packing, rangecoder, tokens

ODD = ["a  b\n c\n\nd  \n e  f　 g  h 'll x's it's I'M", "", " ", "\n", " \n x", "x \n", "tab\tfoo <|endoftext|> b", "é x İ Σ ΑΣ\nß", "x" * 5000, "中文 中。", "12 345.6,7", " \n\nB", "a \nB"]
FILES = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]


def enc(name, kind):
    return tokens.encoder(tokens.default_path(name), kind)


@pytest.mark.parametrize(("name", "kind"), FILES)
@given(st.lists(st.text(st.sampled_from("ab .,'s\n\t é　Z9́"), max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_pieces_give_the_ids_of_the_text(name, kind, texts):
    e = enc(name, kind)
    texts = texts + ODD
    got = [ids[b[i] : b[i + 1]].tolist() for _, ids, b in e.encode(pa.array([*texts, None], pa.string()), 2) for i in range(len(b) - 1)]
    assert got == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, ""]]


@pytest.mark.parametrize("top", [3, 300, 50_257, 2**31])
@pytest.mark.parametrize("n", [0, 1, 63, 700])
def test_coder_round_trip(top, n):
    ids = np.random.default_rng(n).integers(0, top, n)
    ids[n // 2 :] = ids[: n - n // 2] if n else ids[:0]
    codes = rangecoder.encode_blocks(ids, 64, top > 65_536)
    assert (rangecoder.decode_blocks(codes, n, 64, top > 65_536) == ids).all()


def test_blocks_are_independent():
    ids = np.random.default_rng(1).integers(0, 50, 256)
    whole = rangecoder.encode_blocks(ids, 64, False)
    assert whole[2] == rangecoder.encode_blocks(ids[128:192], 64, False)[0]


def test_section_round_trip_and_checksum():
    ids = np.random.default_rng(2).integers(0, 1000, 900).astype(np.uint32)
    payload = binary.write_section([5, None, 7], np.array([400, 0, 500]), ids, 128)
    names, counts, back = binary.read_section(payload)
    assert names == [5, None, 7] and counts.tolist() == [400, 0, 500] and (back == ids).all()
    bad = bytearray(payload)
    bad[-40] ^= 255
    with pytest.raises(binary.CorruptBlock):
        binary.read_section(bytes(bad))


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")


ROWS = [(7, "some text here", 1, "x"), (3, None, 2, "y"), (None, "null id", 3, "z"), (7, "some text here", 4, "w"), (9, "", 5, "v"), (1, "word " * 3000, 6, "u")]


def test_token_output(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "SECTION_TOKENS", 50)
    e = enc(*FILES[0]).tokenizer
    target = f"file://{tmp_path}/t"
    binary.write_tokens(rows_of(spark, ROWS), target, tokens.default_path(FILES[0][0]), shards=3)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) for r in binary.read_tokens(spark, target, with_ids=True).collect()), key=lambda r: r[0])
    assert [g[1] for g in got] == [None, 1, 3, 7, 7, 9]
    at = 0
    for (start, doc_id, n, crc, ids), text in zip(got, ["null id", "word " * 3000, "", "some text here", "some text here", ""], strict=True):
        want = [*e.encode(text, add_special_tokens=False).ids, 2]
        assert (start, n, crc, ids) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)
        at += n


def test_token_output_of_nothing(spark, tmp_path):
    binary.write_tokens(rows_of(spark, []), f"file://{tmp_path}/t", tokens.default_path(FILES[0][0]), shards=2)
    assert binary.read_tokens(spark, f"file://{tmp_path}/t").count() == 0


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL_TOKENS", 700)
    e = enc(*FILES[1]).tokenizer
    rows = [(i, "word number " * (i * 37 % 900), 0, "") for i in range(40)] + ROWS
    got = packing.packed(rows_of(spark, rows).coalesce(2)).collect()
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    assert padding < 2048 * 3
    lengths = sorted(r["doc_tokens"] for r in got if r["start"] == 0)
    assert lengths == sorted(len(e.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 7 and r["doc_id"] not in (1, 3, 9):
            ids = np.array([*e.encode(dict((i, t) for i, t, *_ in rows[:40])[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in got) == sum(lengths)
    assert packing.packed(rows_of(spark, [])).count() == 0


@pytest.mark.parametrize(("name", "kind"), FILES)
def test_edits_follow_full_encoding(name, kind):
    rng = random.Random(3)
    e = enc(name, kind)
    texts = [*ODD, "Some words, and more. " * 200, "été 中 " * 300]
    for r, tree in edits.built(e, pa.array(texts)):
        s = texts[r]
        assert tree.tokens == len(e.tokenizer.encode(s, add_special_tokens=False).ids)
        for _ in range(12):
            a, d, new = rng.randint(0, len(s) + 3), rng.choice([0, 1, 3, 40, 4000]), rng.choice(["", " ", "x", " foo bar", "\n", "é ", "'s ", "  \n\n "])
            edits.apply_edit(e, tree, a, d, new)
            s = s[:a] + new + s[a + d :]
            assert tree.text().decode() == s
            assert tree.tokens == len(e.tokenizer.encode(s, add_special_tokens=False).ids)


def test_edited_counts(spark):
    df = spark.createDataFrame([(1, "a few words " * 500, [(0, 0, "x "), (5, 3, None)]), (2, None, None), (2, None, []), (None, "z", [(None, 9, "")])], "doc_id long, text string, edits array<struct<start:long,removed:long,added:string>>")
    got = {(r["doc_id"], r["n_edits"]): r for r in edits.edited_counts(df).collect()}
    assert len(got) == 3 and got[None, 1]["n_tokens_edited"] == 0 and got[2, 0]["n_tokens"] == 0
    assert got[1, 2]["bytes_encoded_again"] < got[1, 2]["bytes_edited"] / 5
    assert edits.edited_counts(df.limit(0)).count() == 0
    assert edits.trees(df).where("n_tokens = aggregate(leaf_tokens, 0, (a, x) -> a + x)").count() == 4


def test_stored_trees_are_taken_up_again(spark):
    long = "some wörds, and more <|endoftext|> " * 700
    rows = [(1, long, [(40, 3, "new words "), (9000, 60, None)]), (2, None, None), (3, "plain", [(5, 0, " end " * 400)]), (3, "plain", []), (4, "changed since", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,removed:long,added:string>>")
    old = df.selectExpr("doc_id", "if(doc_id = 4, 'as it was', text) AS text")
    kept = spark.createDataFrame(edits.trees(old).collect(), edits.STORED)  # doc_id 3 is stored twice
    fresh, resumed = edits.edited_counts(df), edits.edited_counts(df, stored=kept)
    by_row = lambda t: sorted(map(tuple, t.drop("bytes_built").collect()))
    assert by_row(fresh) == by_row(resumed)
    assert {r["doc_id"]: r["bytes_built"] for r in resumed.collect()} == {1: 0, 2: 0, 3: 0, 4: len("changed since")}
    after = edits.edited_trees(df, stored=kept)
    plain = enc(*FILES[0]).tokenizer
    got = {(r["doc_id"], r["text"]): r for r in after.collect()}
    assert set(got) == {(1, (t := long[:40] + "new words " + long[43:])[:9000] + t[9060:]), (2, ""), (3, "plain" + " end " * 400), (3, "plain"), (4, "changed since")}
    for (_, text), r in got.items():
        assert r["n_tokens"] == sum(r["leaf_tokens"]) == len(plain.encode(text, add_special_tokens=False).ids)
        assert sum(r["leaf_bytes"]) == len(text.encode())
    again = spark.createDataFrame([(k, t, [(0, 1, "A")]) for k, t in got], "doc_id long, text string, edits array<struct<start:long,removed:long,added:string>>")
    counted = edits.edited_counts(again, stored=spark.createDataFrame(after.drop("text").collect(), edits.STORED))
    assert counted.agg({"bytes_built": "sum"}).first()[0] == 0
    assert sorted(r["n_tokens_edited"] for r in counted.collect()) == sorted(len(plain.encode("A" + t[1:], add_special_tokens=False).ids) for _, t in got)


def test_edits_reencode_regions_only_and_leaves_are_dealt_again():
    e = enc(*FILES[0])
    (_, tree), *_ = edits.built(e, pa.array(["many words, é too. " * 40_000]))
    n = tree.leaves
    for k in range(300):  # one place grows: leaves there must not
        assert edits.apply_edit(e, tree, 5000, 0, " and more") < 4000
    assert tree.leaves > n
    s = "many words, é too. " * 40_000
    assert tree.text().decode() == s[:5000] + " and more" * 300 + s[5000:]


MARKED = ["tab foo <|endoftext|> b", "<|endoftext|>", "a   <|endoftext|>   b", "x<|endoftext|>'s <|startoftext|><|endoftext|>é", "<|endof<|endoftext|>", "\n<|endoftext|>\n\n b", "<|endoftext", "|> a", "<|ENDOFTEXT|>", "e<|endoftext|>\u0301 <|startoftext|>z", "a    ", "b"]


@pytest.mark.parametrize(("name", "kind"), FILES)
def test_added_tokens_are_matched_as_by_a_fresh_tokenizer(name, kind):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(tokens.default_path(name)), random.Random(8)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "a", "B.", "'s", "é", "\u0301"]
    texts = MARKED + ["".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(400)]
    got = [ids[b[i] : b[i + 1]].tolist() for _, ids, b in enc(name, kind).encode(pa.array(texts)) for i in range(len(b) - 1)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "kind"), FILES)
def test_edits_make_and_break_added_tokens(name, kind):
    from tokenizers import Tokenizer

    plain, rng, e = Tokenizer.from_file(tokens.default_path(name)), random.Random(9), enc(name, kind)
    for _, tree in edits.built(e, pa.array(["some words <|endoftext|> and <|endof text|>, " * 30, "x<|startoftext|>" * 80])):
        for _ in range(60):
            s = tree.text().decode()
            a = rng.choice([m for m in range(len(s)) if s[m] in "<|>x "])
            edits.apply_edit(e, tree, a, rng.choice([0, 1, 3, 13]), rng.choice(["", "<|endoftext|>", "<|endof", "text|>", " ", "  <|startoftext"]))
            assert tree.tokens == len(plain.encode(tree.text().decode(), add_special_tokens=False).ids)


def test_added_tokens_that_strip_are_encoded_by_whole_rows(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    plain = Tokenizer.from_file(tokens.default_path(FILES[0][0]))
    plain.add_tokens([AddedToken("<sep>", lstrip=True, rstrip=True), AddedToken("word", single_word=True)])
    plain.save(str(tmp_path / "t.json"))
    texts = ["a  <sep>  b", "word words a word.", "", "x <|endoftext|> <sep>"]
    got = [ids[b[i] : b[i + 1]].tolist() for _, ids, b in tokens.encoder(str(tmp_path / "t.json"), "byte").encode(pa.array(texts)) for i in range(len(b) - 1)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
