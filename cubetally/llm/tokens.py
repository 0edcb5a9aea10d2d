"""Token ids of whole texts, by encoding each distinct piece of a batch once.

A text is cut only where its tokenizer's pre-tokenizer always cuts, so that the ids of a text are the ids
of its pieces put together.  ``byte`` (byte-level BPE: a space belongs to the word after it): before a
space that something other than white space follows, and around a lone line feed.  ``word`` (white space
is dropped): at ASCII white space.  Both: between an ASCII letter and ASCII punctuation.  A byte that could open a Unicode space is never taken as a cut.
The literals of the file's added tokens (``<|endoftext|>``) are pieces of their own, and what stands before and after
one is cut like a text that ends or begins there.  A file whose added tokens strip space, need a word's edge, are
matched in normalized text or can overlap is encoded by whole rows.

Pieces are known by two independent 64-bit hashes of their bytes.  A new piece of letters only (below U+0530, where
Unicode versions agree) is one pre-token and goes to the tokenizer's model directly; any other goes through the whole
tokenizer.  A file for which the two ways differ on a few probes uses the second for all.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa

from cubetally.llm.arrowtext import _SPACE, byte_table, column_bytes, first_flags, mix64, powers, slices

_INK = np.zeros(256, bool)  # surely no white space: printable ASCII and lead bytes that open no Unicode space
_INK[0x21:0x7F] = True
_INK[0xC3:0xE1] = True
_INK[0xE4:0xF5] = True
_ASCII_INK = np.zeros(256, bool)
_ASCII_INK[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = _ASCII_INK & ~_LETTER
_PUNCTUATION[0x30:0x3A] = False
CACHE_PIECES = 1 << 20
CACHE_FEW = 100_000


def default_path(name: str) -> str:
    """Place of a public tokenizer file; the package that knows it is only needed where the default is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(raw: np.ndarray, offs: np.ndarray, kind: str) -> np.ndarray:
    """Byte positions where pieces begin; every row with text begins one."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if kind == "word":
        space = _SPACE[raw]
        cut[1:n] = space[:-1] & ~space[1:]
    else:
        ink = _INK[raw]
        cut[: n - 1] = (raw[:-1] == 0x20) & ink[1:]
        lone = np.flatnonzero((raw[1:-1] == 0x0A) & _ASCII_INK[raw[:-2]] & ink[2:]) + 1
        inside = first_flags(n, offs)
        lone = lone[~inside[lone] & ~inside[np.minimum(lone + 1, n - 1)]]
        cut[lone] = True
        cut[lone + 1] = True
        edge = offs[offs > 0]
        cut[edge[raw[edge - 1] == 0x20] - 1] = False  # a row's last space has nothing after it
    cut[1:n] |= _LETTER[raw[:-1]] & _PUNCTUATION[raw[1:]]
    cut[offs] = True
    cut[n] = False
    return np.flatnonzero(cut)


class PieceTable:
    """Open-addressing table from 128-bit piece hashes to entries; entries not used lately go when it is full."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bits = max(10, (2 * capacity).bit_length())
        self._empty()

    def _empty(self) -> None:
        self.size = self.used = 0
        self.key, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)  # key 0: free
        self.grown = {"hash": np.zeros(1 << 10, np.uint64), "check": np.zeros(1 << 10, np.uint64), "first": np.zeros(1 << 10, np.int64), "count": np.zeros(1 << 10, np.int32), "stamp": np.zeros(1 << 10, np.int32), "pool": np.zeros(1 << 12, np.uint32)}
        self.clock = 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        have = self.grown[name]
        if at + len(values) > len(have):  # room to grow, so that a few new pieces do not copy all
            have = np.concatenate([have[:at], np.zeros(len(have) + len(values), have.dtype)])
            self.grown[name] = have
        have[at : at + len(values)] = values

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands, or the free place where it would."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            found = self.key[at[left]]
            left = left[(found != h[left]) & (found != 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return at

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 if it has none; entries found count as used now."""
        at = self._places(h)
        entry = np.where(self.key[at] == h, self.entry[at], -1)
        entry[(entry >= 0) & (self.grown["check"][entry] != check)] = -1
        self.clock += 1
        self.grown["stamp"][entry[entry >= 0]] = self.clock
        return entry

    def _index(self, h: np.ndarray, entry: np.ndarray) -> None:
        while len(h):
            at = self._places(h)
            free = self.key[at] == 0
            self.key[at[free]] = h[free]
            mine = free & (self.key[at] == h)
            self.entry[at[mine]] = entry[mine]
            h, entry = h[~mine & free], entry[~mine & free]  # those that lost a free place; a twin in ``hash`` alone stays out

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Entries of new pieces with their ids one after the other; room must have been made."""
        entry = np.arange(self.size, self.size + len(h))
        for name, values in (("hash", h), ("check", check), ("first", self.used + np.cumsum(count) - count), ("count", count), ("stamp", np.full(len(h), self.clock))):
            self._put(name, self.size, values)
        self._put("pool", self.used, ids)
        self.used += len(ids)
        self.size += len(h)
        self._index(h, entry)
        return entry

    def make_room(self, n: int) -> bool:
        """Whether entries were moved: if ``n`` more do not fit, the half used longest ago goes (all, if that is not enough).

        A run of text with more new pieces than the capacity gets a table that holds them.
        """
        if self.size + n <= self.capacity:
            return False
        old, size = self.grown, self.size
        self.bits = max(10, (2 * max(n, self.capacity)).bit_length())
        keep = np.zeros(0, np.int64)
        if n <= self.capacity // 2:
            keep = np.sort(np.argsort(-old["stamp"][:size], kind="stable")[: self.capacity // 2])
        clock = self.clock
        self._empty()
        self.clock = clock
        count = old["count"][keep].astype(np.int64)
        upto = np.append(0, np.cumsum(count))
        ids = old["pool"][np.repeat(old["first"][keep] - upto[:-1], count) + np.arange(upto[-1])]
        self.add(old["hash"][keep], old["check"][keep], ids, count)
        self.grown["stamp"][: len(keep)] = old["stamp"][keep]
        return True


_ANY = byte_table(29, None, False), byte_table(31, None, False)


def piece_hashes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each (non-empty) string: pieces count as equal when both are."""
    raw, offs = column_bytes(pieces)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    start, at = offs[:-1], powers(len(raw))
    size = np.diff(offs).astype(np.uint64)
    one, two = (mix64(np.add.reduceat(t[raw] * at, start) * powers(len(raw), True)[start] + size) for t in _ANY)
    return np.maximum(one, np.uint64(1)), two


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_UNSURE = frozenset("\u0130\u0374\u03a3")  # letters below U+0530 that normal forms or lower case treat by context


class PieceEncoder:
    """Encodes string columns with a tokenizers file; one a worker process, its cache is bounded."""

    def __init__(self, path: str, kind: str, cache: int = CACHE_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        words = sorted({t.content.encode() for t in added}, key=lambda w: (-len(w), w))
        clash = any(a != b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))) for a in words for b in words)
        self.whole_rows = clash or any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added)
        self.literal = re.compile(b"|".join(map(re.escape, words))) if words else None
        self.reach = max(map(len, words), default=0)  # bytes around a cut that a literal can make it depend on
        self.table = PieceTable(cache)
        self.few: dict[str, int] = {}
        probes = ["word", " Word", "\u00e9t\u00e9", " na\u00efvet\u00e9", "Zz", " \u0434\u043e\u043c"]
        probes = [p.strip() if kind == "word" else p for p in probes]
        self.plain_words = True
        ids, size = self._encoded(probes)
        self.plain_words = False
        wanted, wanted_size = self._encoded(probes)
        self.plain_words = ids.tolist() == wanted.tolist() and size.tolist() == wanted_size.tolist()

    def _word(self, piece: str) -> str | None:
        """``piece`` in the byte-level alphabet if it is surely one pre-token of letters, after a space at most."""
        letters = piece[1:] if self.kind == "byte" and piece[0] == " " else piece
        if not letters.isalpha() or (not letters.isascii() and (max(letters) > "\u052f" or not _UNSURE.isdisjoint(letters))):
            return None
        if self.kind == "word":
            piece = piece.lower()
        if letters.isascii():
            return piece if letters is piece or self.kind == "word" else "\u0120" + letters
        return piece.encode().decode("latin-1").translate(_LETTERS)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids of each piece): words of letters by the tokenizer's model, the others by the whole tokenizer."""
        flat: list[list[int] | None] = [None] * len(pieces)
        rest = []
        if self.plain_words:
            tokenize, word = self.tokenizer.model.tokenize, self._word
            for i, p in enumerate(pieces):
                w = word(p)
                if w is None:
                    rest.append(i)
                else:
                    flat[i] = [t.id for t in tokenize(w)]
        else:
            rest = list(range(len(pieces)))
        for k in range(0, len(rest), 8192):  # one call for many pieces; word_ids tells whose each id is
            part = rest[k : k + 8192]
            got = self.tokenizer.encode([pieces[i] for i in part], is_pretokenized=True, add_special_tokens=False)
            ids, size = got.ids, np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)).tolist()
            at = 0
            for i, n in zip(part, size, strict=True):
                flat[i] = ids[at : at + n]
                at += n
        return np.fromiter(chain.from_iterable(flat), np.uint32), np.fromiter(map(len, flat), np.int64, len(flat))

    def _entries(self, pieces: pa.Array) -> np.ndarray:
        """Table entry of each of some distinct pieces; new ones are encoded."""
        h, check = piece_hashes(pieces)
        entry = self.table.find(h, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.table.make_room(len(new)):
                entry = self.table.find(h, check)
                new = np.flatnonzero(entry < 0)
            ids, size = self._encoded(pieces.take(pa.array(new)).to_pylist())
            entry[new] = self.table.add(h[new], check[new], ids, size)
        return entry

    def count_few(self, pieces: list[str]) -> np.ndarray:
        """Number of ids of each of a few pieces (an edit's); kept apart from the table, which is for whole batches."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.few]
        if new:
            if len(self.few) + len(new) > CACHE_FEW:
                self.few.clear()
                new = list(dict.fromkeys(pieces))
            self.few.update(zip(new, self._encoded(new)[1].tolist(), strict=True))
        return np.fromiter(map(self.few.__getitem__, pieces), np.int64, len(pieces))

    def starts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Byte positions where pieces begin, added tokens' literals among them."""
        if self.whole_rows:
            return offs[:-1][np.diff(offs) > 0]
        spans, at = [], 0
        while self.literal and (m := self.literal.search(raw, at)):
            row_end = int(offs[np.searchsorted(offs, m.start(), "right")])
            inside = m.end() <= row_end
            if inside:
                spans.append(m.span())
            at = m.end() if inside else m.start() + 1
        if not spans:
            return piece_starts(raw, offs, self.kind)
        first, end = np.array(spans, np.int64).T
        starts = piece_starts(raw, np.union1d(offs, np.concatenate([first, end])), self.kind)
        return starts[starts >= np.append(0, end)[np.searchsorted(first, starts)]]

    def pieces(self, column: pa.Array):
        """(first row, bytes, byte starts of pieces, first piece of each row, table entry of each piece) for runs of whole rows.

        Entries hold until the next run.
        """
        for first, _, raw, offs in slices(column):
            if len(raw):
                starts = self.starts(raw, offs)
                large = len(raw) > 2**31 - 1
                edges = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64 if large else np.int32))
                text = pa.Array.from_buffers(pa.large_string() if large else pa.string(), len(starts), [None, edges, pa.py_buffer(raw)])
                coded = text.dictionary_encode()
                yield first, raw, starts, np.searchsorted(starts, offs), self._entries(coded.dictionary)[coded.indices.to_numpy()]
            else:
                yield first, raw, np.zeros(0, np.int64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)

    def counts(self, entries: np.ndarray) -> np.ndarray:
        return self.table.grown["count"][entries].astype(np.int64)

    def encode(self, column: pa.Array, end_id: int | None = None):
        """(first row, ids, row bounds) for runs of whole rows; ``end_id`` closes each row if given."""
        for first, _, _, piece_row, at in self.pieces(column):
            size = self.counts(at)
            upto = np.zeros(len(at) + 1, np.int64)
            np.cumsum(size, out=upto[1:])
            bounds = upto[piece_row]
            source = self.table.grown["first"][at] - upto[:-1]
            if end_id is None:
                yield first, self.table.grown["pool"][np.repeat(source, size) + np.arange(upto[-1])], bounds
                continue
            rows = len(bounds) - 1
            flat = np.empty(upto[-1] + rows, np.uint32)
            ends = bounds[1:] + np.arange(rows)
            inside = np.ones(len(flat), bool)
            inside[ends] = False
            flat[inside] = self.table.grown["pool"][np.repeat(source, size) + np.arange(upto[-1])]
            flat[ends] = end_id
            yield first, flat, bounds + np.arange(len(bounds))


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]


def crc_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
