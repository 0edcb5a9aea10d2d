"""Quality: supervised subword embeddings.

Method: every white-space word and every character n-gram (3 and 4 characters of the word with its
boundaries, case kept) is hashed to a bucket that has a learned vector; a document is the average of its
vectors, and a softmax layer over that average gives the class.  Vectors and layer are trained by plain
stochastic gradient descent in numpy on a bounded sample (PER_CLASS whole documents of each class at most).  As the softmax of two classes depends on the difference of their logits only,
scoring needs one number a bucket: vector . (w1 - w0).

Cases: null, empty or white-space text scores as the bias alone; repeated rows each get their score;
without labelled rows of both classes the score is 0.5 and predicted 0; extra columns are kept by
``score`` and a clash with an output name is resolved in favour of the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cubetally.llm import charfeatures as cf
from cubetally.llm.arrowtext import releasing, slices
from cubetally.llm.labels import training_rows, with_fold

ORDERS = (3, 4)
BITS = 17
DIMENSIONS = 8
PER_CLASS = 1500
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.7


def document_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct buckets, how often each occurs)."""
    for first, to, raw, offs in slices(column, 1 << 20):
        points, at = cf.characters(raw, offs)
        b, who = cf.word_features(points, at, ORDERS, BITS)
        keys, n = np.unique((who << BITS) | b, return_counts=True)
        cut = np.searchsorted(keys, np.arange(to - first + 1) << BITS)
        for r in range(to - first):
            part = slice(cut[r], cut[r + 1])
            yield first + r, keys[part] & ((1 << BITS) - 1), n[part]


def fit(texts: pa.Array, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(one logit a bucket, bias): the embeddings folded with the softmax layer."""
    y = np.asarray(y, np.int64)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS))
    layer, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    seen = np.zeros(1 << BITS, bool)
    rows = []
    for _, b, n in document_features(texts):
        seen[b] = True
        rows.append((b, (n / max(1, n.sum()))[:, None]))
    by_class = [np.flatnonzero(y == c) for c in (0, 1)]
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        # the classes take turns, so that the rarer one is not drowned out
        for k in order:
            c = int(k & 1)
            i = by_class[c][rng.integers(len(by_class[c]))]
            b, share = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            h = (vectors[b] * share).sum(0)
            logit = layer @ h + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer.T @ p
            layer -= rate * np.outer(p, h)
            bias -= rate * 0.1 * p
            # each vector moves by its share of the average; the count-free scale keeps long documents moving
            vectors[b] -= rate * np.sqrt(share) * back
    vectors[~seen] = 0
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


class Model:
    """One float32 logit for each of 2**BITS buckets (0.5 MB) and a bias."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, to, raw, offs in slices(column):
            points, at = cf.characters(raw, offs)
            b, who = cf.word_features(points, at, ORDERS, BITS)
            n = np.bincount(who, minlength=to - first)
            out[first:to] = np.bincount(who, self.logits[b], to - first) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2) -> Model:
    """Fit on the bounded sample in one task; the driver gets the folded weights."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by([("text", "ascending"), ("y", "ascending")]).combine_chunks()
        logits, bias = fit(table["text"].chunk(0), table["y"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([logits.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["logits", "bias"])

    sample = training_rows(documents, labels, label, folds, held_out, PER_CLASS)
    got = sample.repartition(1).mapInArrow(releasing(task), "logits binary, bias double").collect()
    if not got:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(got[0]["logits"], np.float32), got[0]["bias"])


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``documents`` plus score and predicted."""
    kept = [f for f in documents.schema.fields if f.name not in ("score", "predicted")]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = [f.name for f in kept].index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return documents.select(*[documents[f.name] for f in kept]).mapInArrow(releasing(task), schema)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", with_fold(documents, 4, 2).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
