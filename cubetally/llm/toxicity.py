"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Method: binarised n-grams (3 to 5 characters, ASCII case folded, hashed), each scaled by its log-count
ratio r = log((p / |p|) / (q / |q|)), p and q being the smoothed counts in toxic and clean documents;
a logistic regression is trained on the scaled features and folded into one weight a bucket.  Buckets
whose ratio is not significant (|r| under Z_LEAST standard errors) get weight 0.

Training uses a bounded sample (PER_CLASS whole documents of each class at most) in
one task; scoring streams over all whole texts with no shuffle.

Cases: null or empty text scores as a document without n-grams (the bias alone); repeated rows each get
their score; no labelled rows at all gives 0.5 and predicted 0; extra columns are kept by ``score`` and
a clash with an output name is resolved in favour of the output.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.llm import charfeatures as cf
from cubetally.llm.arrowtext import releasing, slices
from cubetally.llm.labels import training_rows, with_fold

ORDERS = (3, 4, 5)
BITS = 20
PER_CLASS = 2500
Z_LEAST = 4.0
MOST_FEATURES = 30_000
BLOCK_ENTRIES = 1 << 19
SLICE = 1 << 20
THRESHOLD = 0.7


def fit(texts: pa.Array, y: np.ndarray, smooth: float = 1.0, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) from training texts; empty buckets and bias 0 when a class is missing."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    counts = [np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)]
    rows = []
    for r, buckets in cf.sparse_rows(texts, ORDERS, BITS):
        counts[int(y[r])][buckets] += 1
        rows.append(buckets.astype(np.int32))
    n1, n0 = y.sum(), (1 - y).sum()
    p, q = counts[1] + smooth, counts[0] + smooth
    # presence odds: each class is normalised by its number of documents, so a longer class does not tilt r
    ratio = np.log((p / (n1 + 2 * smooth)) / (q / (n0 + 2 * smooth)))
    z = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    z[counts[0] + counts[1] == 0] = 0
    chosen = np.flatnonzero(z >= Z_LEAST)
    if len(chosen) > MOST_FEATURES:
        chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")[:MOST_FEATURES]])
    index = np.full(1 << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    rows = [(c := index[b])[c >= 0] for b in rows]
    # entries in blocks of documents: (first document, end, features, document of each entry)
    upto = np.append(0, np.cumsum([len(c) for c in rows]))
    edges = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], BLOCK_ENTRIES)), [0, len(rows)]))
    blocks = [(i, j, np.concatenate(rows[i:j]), np.repeat(np.arange(j - i, dtype=np.int32), np.diff(upto[i : j + 1]))) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    del rows
    scale = ratio[chosen]
    w, bias, m_w, v_w, m_b, v_b = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for step in range(1, steps + 1):  # Adam on the whole sample: a fixed number of steps, no random order
        scaled, gw, gb = scale * w, np.zeros(len(chosen)), 0.0
        for i, j, features, owner in blocks:
            logit = np.bincount(owner, scaled[features], j - i) + bias
            g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[i:j]) * weight[i:j]
            gw += np.bincount(features, g[owner], len(chosen))
            gb += g.sum()
        gw = gw * scale + l2 / len(y) * w
        m_w, v_w = 0.9 * m_w + 0.1 * gw, 0.999 * v_w + 0.001 * gw * gw
        m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.999 * v_b + 0.001 * gb * gb
        rate, c1, c2 = 0.02, 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m_w / c1) / (np.sqrt(v_w / c2) + 1e-8)
        bias -= rate * (m_b / c1) / (np.sqrt(v_b / c2) + 1e-8)
    return chosen, w * scale, float(bias)


class Model:
    """Weights by bucket; small enough to broadcast (at most MOST_FEATURES weights)."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = np.asarray(buckets, np.int64), np.asarray(weights, np.float64), float(bias)
        self._table = None

    def __getstate__(self):
        return self.buckets, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def logits(self, column: pa.Array) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.int32)
            self._table[self.buckets] = np.arange(1, len(self.buckets) + 1)
        out = np.full(len(column), self.bias)
        for first, to, raw, offs in slices(column, SLICE):
            points, at = cf.characters(raw, offs)
            points = cf.fold(points)
            rows = np.repeat(np.arange(to - first), np.diff(at))
            hits = []
            for b, ok in cf.row_ngrams(points, at, ORDERS, BITS):
                f = self._table[b]
                hit = np.flatnonzero((f > 0) & ok)
                hits.append(rows[hit] * (len(self.buckets) + 1) + f[hit])
            hits = np.unique(np.concatenate(hits))  # present or not, however often
            who, f = np.divmod(hits, len(self.buckets) + 1)
            out[first:to] += np.bincount(who, self.weights[f - 1], to - first)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(column), -500, 500)))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1) -> Model:
    """Fit on the bounded sample in one task; the driver gets the weights only."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(got) if got else None
        if table is None:
            return
        # by text, as the order in which rows arrive is not fixed
        table = table.sort_by([("text", "ascending"), ("y", "ascending")]).combine_chunks()
        buckets, weights, bias = fit(table["text"].chunk(0) if table["text"].num_chunks else pa.array([], pa.string()), table["y"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(buckets, -1)), pa.array(np.append(weights, bias))], ["bucket", "weight"])

    sample = training_rows(documents, labels, label, folds, held_out, PER_CLASS)
    got = sample.repartition(1).mapInArrow(releasing(task), "bucket long, weight double").toPandas()
    real = got[got.bucket >= 0]
    return Model(real.bucket.to_numpy(), real.weight.to_numpy(), float(got.weight[got.bucket < 0].sum()))


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``documents`` plus the score and the prediction under ``names``, in place of columns so named."""
    kept = [f for f in documents.schema.fields if f.name not in names]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = [f.name for f in kept].index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, *names])

    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return documents.select(*[documents[f.name] for f in kept]).mapInArrow(releasing(task), schema)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    model = train(documents, labels)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", with_fold(documents, 3, 1).alias("held_out"), "score", "predicted")


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, columns unchanged."""
    model = train(documents, labels)
    own = f"score_{uuid.uuid4().hex}", f"predicted_{uuid.uuid4().hex}"  # names that no input column has
    return score(documents, model, names=own).where(F.col(own[1]) == 0).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
