"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

Base spans (email, ip, card, phone) follow fixed patterns, matched in linear time.  The field labels
segments of one to MOST_WORDS words as one of these kinds or as background.  Its features look at a whole
segment (shape, digit count, Luhn sum, separators, words beside it), and a dynamic program over bounded
segments chooses boundaries and kinds jointly.  Background words score 0, so only stretches around triggers
need the program: digits, at signs, "[at]", "(at)", and "at" before a word with a dot in it or a "dot" after it.
A window reaches MOST_WORDS - 1 words to both sides of a trigger, so that it has every segment with one; the
best path elsewhere is background.  However long a stretch is, it is one window: the program runs over it in one
pass with two small numbers a word and label.

The weights are trained here, by gradient steps on the exact log-likelihood (forward and backward sums over
segmentations) of a bounded sample: the first WINDOWS windows of SAMPLE documents with candidates, labelled by the base patterns, plus
rewritten forms of the same spans (no plus sign, dots for hyphens, "[at]" ...) that the patterns miss.  For training alone, a window of more than TRAIN_WORDS words is cut between spans.

A segment that the field reports is added as crf_<kind> unless it overlaps a base span; base spans stay.

Cases: null or empty text has no spans and the sha256 of the empty string; repeated rows are scanned once
each; an empty table gives no rows; without any candidate the field has no weights and adds nothing;
``redacted`` keeps all columns of its input, ``pii_spans`` reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.llm.arrowtext import _SPACE, first_flags, releasing, slices

# fixed values: kinds in their listed order, and the base patterns
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a later start in a run of digits fails like its first
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

LABELS = ("background", *KINDS)
NAMES = KINDS + tuple(f"crf_{k}" for k in KINDS)
MOST_WORDS = 5
BUCKETS = 1 << 12
SAMPLE = 400
EPOCHS = 6
WINDOWS = 12  # of a sample document and of its rewritten form, in fitting only
TRAIN_WORDS = 64

Span = tuple[int, int, int]  # start, kind, end: sorts by start, then kind as listed


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(t: str) -> list[Span]:
    """The four base kinds, leftmost and non-overlapping each; matches that fail a check are dropped."""
    out: list[Span] = []
    end = barrier = 0
    for m in DOMAIN.finditer(t):
        at = m.start()
        lowest = max(end, barrier)
        start = lowest + len(t[lowest:at].rstrip(LOCAL))
        barrier = at + 1
        if start < at:
            end = m.end()
            out.append((start, 0, end))
    if t.count(".") >= 3:
        for m in IP.finditer(t):
            # a part of many digits is too large unless they are zeros
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = r"[\x20\x09-\x0D]"
TRIGGER = re.compile(  # one class first: the search skips to it
    r"[0-9@\[(Aa](?:(?<=[0-9@])|(?<=[\[(])[Aa][Tt][\])]|(?<=[Aa])[Tt](?<![^\x20\x09-\x0D]..)"
    rf"(?={_GAP}+[^\x20\x09-\x0D.]+(?:\.[A-Za-z0-9]|{_GAP}+[Dd][Oo][Tt](?![^\x20\x09-\x0D])|{_GAP}*[\[(][Dd][Oo][Tt][\])])))"
)
SHAPE = [(re.compile(r"[A-Z]+"), "A"), (re.compile(r"[a-zÀ-\U0010ffff]+"), "a")]
SPACES = " \t\n\v\f\r"
EDGE = "\"'.,;:!?|*$%&#<>{}"


def digit_shape(s: str) -> str:
    for pattern, to in SHAPE:
        s = pattern.sub(to, s)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 17)}", s)[:40]


def bucket(feature: str) -> int:
    h = 2166136261
    for c in feature.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h % BUCKETS


def trimmed(t: str, a: int, b: int) -> list[tuple[int, int]]:
    """The extent of a word without edge punctuation; none if nothing else is in it."""
    s = t[a:b]
    left, right = len(s) - len(s.lstrip(EDGE)), len(s.rstrip(EDGE))
    return [(a + left, a + right)] if left < right else []


def words_from(t: str, at: int) -> Iterator[tuple[int, int]]:
    for w in WORD.finditer(t, at):
        yield from trimmed(t, *w.span())


def words_before(t: str, to: int, lowest: int, most: int) -> list[tuple[int, int]]:
    """The last ``most`` words that end before ``to`` and do not begin before ``lowest``."""
    out: list[tuple[int, int]] = []
    while len(out) < most:
        while to > lowest and t[to - 1] in SPACES:
            to -= 1
        if to == lowest:
            break
        end = to
        while to > lowest and t[to - 1] not in SPACES:
            to -= 1
        out += trimmed(t, to, end)
    return out[::-1]


def windows(t: str) -> Iterator[list[tuple[int, int]]]:
    """Word extents (edge punctuation trimmed) of stretches around words with a trigger."""
    reach = MOST_WORDS - 1
    words: list[tuple[int, int]] = []
    end = lowest = 0  # of the last word in words, which has a trigger; of the window before
    for m in TRIGGER.finditer(t):
        if m.start() < end:
            continue
        ahead: list[tuple[int, int]] = []
        for w in words_from(t, end) if words else ():
            ahead.append(w)
            if w[1] > m.start() or len(ahead) > 2 * reach:
                break
        if ahead and ahead[-1][1] > m.start():
            words += ahead
        else:  # windows this far apart share no word
            if words:
                words += ahead[:reach]
                lowest = words[-1][1]
                yield words
            start = m.start()
            while start > lowest and t[start - 1] not in SPACES:
                start -= 1
            words = [*words_before(t, start, lowest, reach), next(words_from(t, start))]
        end = words[-1][1]
    if words:
        yield words + list(islice(words_from(t, end), reach))


def segment_features(t: str, words: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Buckets of the features of words i to j-1 as one segment."""
    a, b = words[i][0], words[j - 1][1]
    s = t[a:b]
    if len(s) > 80:
        return [bucket("long")]
    digits = NOT_DIGIT.sub("", s)
    letters = sum(c.isalpha() for c in s)
    f = [f"shape={digit_shape(s)}", f"n={j - i}", f"digits={min(len(digits), 21)}", f"letters={min(letters, 3)}", f"signs={''.join(sorted(set(c for c in s if not c.isalnum() and not c.isspace())))[:6]}", f"n,digits={j - i},{min(len(digits), 21)}"]
    if letters == 0 and 12 <= len(digits) <= 19:
        f.append(f"luhn={luhn(digits)}")
    parts = re.split(r"[^0-9]+", s.strip("()[]"))
    if letters == 0 and len(parts) == 4 and all(parts):
        f.append(f"four={all(len(p) <= 3 and int(p) < 256 for p in parts)}")
    low = s.lower()
    f.append(f"at={'@' in s or '[at]' in low or '(at)' in low or ' at ' in low},dot={'.' in s or '[dot]' in low or ' dot ' in low}")
    f.append(f"before={digit_shape(t[words[i - 1][0] : words[i - 1][1]])[:6] if i else '-'}")
    f.append(f"after={digit_shape(t[words[j][0] : words[j][1]])[:6] if j < len(words) else '-'}")
    f.append(f"glued={a > 0 and t[a - 1] in LOCAL}")
    return [bucket(x) for x in f]


class Field:
    """Weights of segment features by kind, and of a kind following a label."""

    def __init__(self, weights: np.ndarray | None = None, follow: np.ndarray | None = None):
        self.weights = np.zeros((BUCKETS, len(KINDS))) if weights is None else weights
        self.follow = np.zeros((len(LABELS), len(LABELS))) if follow is None else follow

    def score(self, t: str, words: list[tuple[int, int]], i: int, j: int) -> tuple[list[int], np.ndarray] | None:
        """(features, score by kind) of words i to j-1 as one segment, if it has a trigger."""
        if not TRIGGER.search(t, words[i][0], words[j - 1][1]):
            return None
        f = segment_features(t, words, i, j)
        return f, self.weights[f].sum(0)

    def scores(self, t: str, words: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[list[int], np.ndarray]]:
        """``score`` of every segment of at most MOST_WORDS words that has a trigger."""
        spans = ((i, j) for i in range(len(words)) for j in range(i + 1, min(i + MOST_WORDS, len(words)) + 1))
        return {(i, j): x for i, j in spans if (x := self.score(t, words, i, j))}

    def best(self, t: str, words: list[tuple[int, int]]) -> list[Span]:
        """Segments of the best segmentation, kinds numbered as in NAMES."""
        n, labels = len(words), len(LABELS)
        best = np.full((n + 1, labels), -np.inf)
        back = np.zeros((n + 1, labels, 2), np.int8)  # words and label before, of the best path to a word and label
        best[0, 0] = 0
        for j in range(1, n + 1):
            for i in range(max(0, j - MOST_WORDS), j):
                if i == j - 1:
                    step = best[i] + self.follow[:, 0]
                    k = int(step.argmax())
                    if step[k] > best[j, 0]:
                        best[j, 0], back[j, 0] = step[k], (j - i, k)
                if scored := self.score(t, words, i, j):
                    for y in range(1, labels):
                        step = best[i] + self.follow[:, y]
                        k = int(step.argmax())
                        v = step[k] + scored[1][y - 1]
                        if v > best[j, y]:
                            best[j, y], back[j, y] = v, (j - i, k)
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, k = j - int(back[j, y, 0]), int(back[j, y, 1])
            if y:
                out.append((words[i][0], len(KINDS) + y - 1, words[j - 1][1]))
            j, y = i, k
        return out[::-1]

    def step(self, t: str, words: list[tuple[int, int]], gold: dict[tuple[int, int], int], rate: float) -> None:
        """One gradient step on log p(gold | words): forward and backward sums over all segmentations."""
        n, labels = len(words), len(LABELS)
        scored = self.scores(t, words)
        segments = [(j - 1, j, np.r_[0.0, scored[j - 1, j][1]] if (j - 1, j) in scored else np.array([0.0] + [-np.inf] * (labels - 1))) for j in range(1, n + 1)]
        segments += [(i, j, np.r_[-np.inf, v]) for (i, j), (_, v) in scored.items() if j - i > 1]
        segments.sort(key=lambda s: (s[1], s[0]))
        forward = np.full((n + 1, labels), -np.inf)
        forward[0, 0] = 0
        for i, j, v in segments:
            forward[j] = np.logaddexp(forward[j], np.logaddexp.reduce(forward[i][:, None] + self.follow, 0) + v)
        backward = np.full((n + 1, labels), -np.inf)
        backward[n] = 0
        for i, j, v in sorted(segments, key=lambda s: (-s[0], s[1])):
            backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(self.follow + (v + backward[j])[None, :], 1))
        total = np.logaddexp.reduce(forward[n])
        back_follow = np.zeros_like(self.follow)
        for i, j, v in segments:
            p = np.exp(forward[i][:, None] + self.follow + (v + backward[j])[None, :] - total)
            back_follow -= p
            if (i, j) in scored:
                g = -p.sum(0)[1:]
                if (i, j) in gold:
                    g[gold[i, j] - 1] += 1
                np.add.at(self.weights, scored[i, j][0], rate * g)
        at, y = 0, 0
        while at < n:
            to, k = next(((j, k) for (i, j), k in gold.items() if i == at), (at + 1, 0))
            back_follow[y, k] += 1
            at, y = to, k
        self.follow += rate * 0.2 * np.nan_to_num(back_follow)


def rewritten(t: str, spans: list[Span], turn: int) -> tuple[str, list[Span]]:
    """``t`` with each span in another form of the same kind."""
    out, at, found = [], 0, []
    size = 0
    for a, k, b in spans:
        if a < at:
            continue
        s = t[a:b]
        if k == 0:
            s = [s.replace("@", "[at]"), s.replace("@", " (at) "), s.replace("@", " at ").replace(".", " dot ", 1)][turn % 3]
        elif k == 1:
            s = [s.replace(".", " . "), s.replace(".", "-"), s.replace(".", "[.]")][turn % 3]
        elif k == 2:
            d = NOT_DIGIT.sub("", s)
            s = [".", "/", "_"][turn % 3].join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            d = NOT_DIGIT.sub("", s)
            s = [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"00{d[:-10]} {d[-10:-7]} {d[-7:-4]} {d[-4:]}"][turn % 3]
        out += [t[at:a], s]
        size += a - at
        found.append((size, k, size + len(s)))
        size += len(s)
        at = b
    return "".join([*out, t[at:]]), found


def parts(words: list[tuple[int, int]], spans: list[Span]) -> Iterator[list[tuple[int, int]]]:
    """``words`` in runs of TRAIN_WORDS words or a few more, so that no span lies in two."""
    at = 0
    while at < len(words):
        to = min(at + TRAIN_WORDS, len(words))
        while to < len(words) and any(a < words[to - 1][1] and b > words[to][0] for a, _, b in spans):
            to += 1
        yield words[at:to]
        at = to


def examples(t: str, spans: list[Span]) -> Iterator[tuple[list[tuple[int, int]], dict[tuple[int, int], int]]]:
    """(words, gold segments) of the windows of ``t``, long ones in parts of about TRAIN_WORDS words."""
    for words in (part for whole in windows(t) for part in parts(whole, spans)):
        gold = {}
        for a, k, b in spans:
            inside = [i for i, (p, q) in enumerate(words) if p < b and q > a]
            if inside and inside[-1] - inside[0] < MOST_WORDS:
                gold.setdefault((inside[0], inside[-1] + 1), k + 1)
        keys = sorted(gold)
        if all(a[1] <= b[0] for a, b in zip(keys, keys[1:], strict=False)):  # base kinds may overlap each other
            yield words, gold


def fit(texts: list[str]) -> Field:
    field = Field()
    work = []
    for n, t in enumerate(texts):
        spans = base_spans(t)
        work += [(t, *x) for x in examples(t, spans)][:WINDOWS]
        if spans:
            other, found = rewritten(t, spans, n)
            work += [(other, *x) for x in examples(other, found)][:WINDOWS]
    order = np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for k in order.permutation(len(work)):
            field.step(*work[k], 0.2 / (1 + epoch))
    return field


def train(documents: DataFrame, text: str = "text") -> Field:
    """Fit on the SAMPLE documents with a candidate whose text hashes are the smallest."""
    some = documents.select(F.col(text).alias("text")).where(F.rlike("text", F.lit("[0-9]{3}|@")))
    some = some.withColumn("h", F.xxhash64("text"))
    # only hashes are ordered; the texts of the SAMPLE least ones are fetched once each, however often they repeat
    pick = some.select("h").distinct().orderBy("h").limit(SAMPLE)
    some = some.join(F.broadcast(pick), "h").groupBy("h").agg(F.min("text").alias("text")).select("text").repartition(1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted({t for b in batches for t in b.column(0).to_pylist()})
        if texts:
            field = fit(texts)
            yield pa.RecordBatch.from_arrays([pa.array([field.weights.tobytes()], pa.binary()), pa.array([field.follow.tobytes()], pa.binary())], ["weights", "follow"])

    got = some.mapInArrow(releasing(task), "weights binary, follow binary").collect()
    if not got:
        return Field()
    return Field(np.frombuffer(got[0]["weights"]).reshape(BUCKETS, -1), np.frombuffer(got[0]["follow"]).reshape(len(LABELS), -1))


def all_spans(t: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans) of one text."""
    base = base_spans(t)
    added = [s for words in windows(t) for s in field.best(t, words) if not any(s[0] < b and a < s[2] for a, _, b in base)]
    return base, sorted(base + added)


_TOUCHED = np.zeros(256, bool)
_TOUCHED[[0x40, *range(0x30, 0x3A)]] = True
_BEFORE_AT, _AFTER_AT = _SPACE.copy(), _SPACE.copy()
_BEFORE_AT[[0x28, 0x5B]] = _AFTER_AT[[0x29, 0x5D]] = True


def touched(column: pa.Array) -> list[int]:
    """Rows whose text has a digit, an at sign or a word "at", bare or in brackets; no other row can have a span."""
    out: list[int] = []
    for first, _, raw, offs in slices(column):
        hit = _TOUCHED[raw]
        low = raw | 0x20
        at = np.flatnonzero((low[:-2] == 0x61) & (low[1:-1] == 0x74) & _AFTER_AT[raw[2:]])
        hit[at[_BEFORE_AT[raw[at - 1]] | first_flags(len(raw), offs)[at]]] = True
        out += (first + np.unique(np.searchsorted(offs, np.flatnonzero(hit), "right") - 1)).tolist()
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def pii_spans(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train(documents))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [nothing] * b.num_rows
            texts = b.column(1)
            for r in touched(texts):
                base, spans = all_spans(texts[r].as_py(), shared.value)
                if spans:
                    rows[r] = (*[sum(s[1] == k for s in base) for k in range(4)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [f.split()[0] for f in schema.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(releasing(task), schema)


def redact(t: str, spans: list[Span]) -> str:
    """``t`` with each span, overlapping ones together, as its kind in brackets."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        a, k, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [t[at:a], f"[{KINDS[k % len(KINDS)].upper()}]"]
        at = b
    return "".join([*out, t[at:]])


def redacted(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """``documents`` with personal data replaced in text; n_chars, if there, follows the new text."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train(documents))
    names = documents.columns
    at = names.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            changed = {}
            for r in touched(texts):
                t = texts[r].as_py()
                _, spans = all_spans(t, shared.value)
                if spans:
                    changed[r] = redact(t, spans)
            if changed:
                new = [changed.get(r, None) if r in changed else v for r, v in enumerate(texts.to_pylist())]
                b = b.set_column(at, b.schema.field(at), pa.array(new, texts.type))
            yield b

    out = documents.mapInArrow(releasing(task), documents.schema)
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
