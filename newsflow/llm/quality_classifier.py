"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, a linear hinge-loss model by dual
coordinate descent, probabilities by a logistic fit on rows kept out of the descent.

Features (indicators, FEATURES of them, so the broadcast model has a fixed size): character-class trigrams (letters, capitals
and digits as classes, ASCII punctuation as itself), runs of one repeated word, hashed words and word pairs.
Training rows are the `rows` labelled rows of the least id hash (default FIT_ROWS, a documented bound: the model is fitted
on the driver); their ids are broadcast, as their number is bounded. Scoring is a map over whole texts, without a shuffle.

Defined cases: null and empty texts have no features and get the score of the bias alone; null labels are ignored; repeated
labels of an id count each; without both classes the score is the smoothed share of label 1 for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import _text as T
from ._session import quoted, small_batches

U = np.uint64
FIT_ROWS = 6_000
THRESHOLD = 0.7
RUNS = (2, 3, 4, 6, 8, 12, 16, 24)
WORD_BITS, CLASS_BITS = 16, 5
FEATURES = (1 << WORD_BITS) + (1 << 3 * CLASS_BITS) + len(RUNS)

_b = np.arange(256)
_CLASS = np.select(
    [np.isin(_b, [0x20, *range(0x09, 0x0E)]), (_b >= 0x41) & (_b <= 0x5A), ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80), (_b >= 0x30) & (_b <= 0x39)],
    [1, 2, 3, 4], 5 + _b % 27).astype(np.int32)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all indicators that are on, in text order."""
    data, off = T.utf8(texts)
    n = len(off) - 1
    on = np.zeros((n, FEATURES), bool)
    if off[-1] > off[0]:
        at = np.repeat(np.arange(n), np.diff(off))
        c = _CLASS[data[off[0] : off[-1]]]
        tri = (c[:-2] << 2 * CLASS_BITS) | (c[1:-1] << CLASS_BITS) | c[2:]
        same = at[:-2] == at[2:]
        on[at[:-2][same], (1 << WORD_BITS) + tri[same]] = True
        h, b = T.words(texts, T.NON_SPACE)
        word = np.repeat(np.arange(n), np.diff(b))
        on[word, (h >> U(64 - WORD_BITS)).astype(np.int64)] = True
        near = word[:-1] == word[1:]
        on[word[:-1][near], (T.pair(h[:-1][near], h[1:][near]) >> U(64 - WORD_BITS)).astype(np.int64)] = True
        if len(h):
            new = np.concatenate(([True], ~(near & (h[:-1] == h[1:]))))
            first = np.flatnonzero(new)
            length = np.diff(np.concatenate((first, [len(h)])))
            for k, run in enumerate(RUNS):
                on[word[first[length >= run]], FEATURES - len(RUNS) + k] = True
    return np.nonzero(on)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batch, "text", 1 << 20):
        for i in range(0, part.num_rows, 256):
            yield part.slice(i, 256)


class Model:
    """weights: of every indicator; a text's margin is their sum over its root count of indicators, plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float, shift: float):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, feature = features(texts)
        n = len(texts)
        size = np.maximum(np.bincount(text, minlength=n), 1)
        margin = np.bincount(text, self.weights[feature], minlength=n) / np.sqrt(size) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss (Hsieh et al., 2008), with a bias feature of value 1."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    q = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    share = np.bincount(y > 0, minlength=2) / len(y)
    upper = cost * np.where(y > 0, 0.5 / share[1], 0.5 / share[0])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), upper[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """scale, shift of P(label 1) = 1 / (1 + exp(-(scale * margin + shift))), with Platt's smoothed targets, by Newton steps."""
    n1 = int((y > 0).sum())
    n0 = len(y) - n1
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def learn(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    y = np.where(labels > 0, 1, -1)
    if len(y) < 2 or len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)

    def ratios(use: np.ndarray) -> np.ndarray:
        p, q = (np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(use & (y == s))]), minlength=FEATURES) + 1.0 for s in (1, -1))
        r = np.log(p / ((use & (y == 1)).sum() + 2)) - np.log(q / ((use & (y == -1)).sum() + 2))
        return np.where(p + q > 4, r, 0.0)  # seen in fewer than three texts: no evidence

    r = ratios(~held)
    use = np.flatnonzero(~held)
    w, bias = descend([rows[i] for i in use], y[use], r)
    check = np.flatnonzero(held) if held.any() else use
    full = w * r
    margin = np.array([full[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + bias for i in check])
    return Model(full, bias, *_logistic(margin, y[check]))


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _blocks(batch):
            text, feature = features(part.column("text"))
            offsets = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))], ["label", "features"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """labels: the rows to learn from; at most `rows` of them, those of least id hash, are used."""
    small_batches(docs.sparkSession)
    ident, label = F.col(quoted(doc_id)), quoted(label)
    hashed = labels.where(F.col(label).isNotNull() & ident.isNotNull()).select(ident.alias("_id"), F.col(label).cast("int").alias("label"))
    sample = hashed.orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    joined = docs.select(ident.alias("_doc"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    got = joined.select("label", "text").mapInArrow(_feature_task, "label int, features array<int>").toArrow()
    listed = got.column("features").combine_chunks()
    values, offsets = listed.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.asarray(listed.value_lengths()))))
    label_values = got.column("label").to_numpy()
    sets = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    # The order of arrival varies from run to run; that of the descent must not.
    order = sorted(range(len(sets)), key=lambda i: (sets[i].tobytes(), label_values[i]))
    order = np.random.default_rng(1).permutation(np.array(order, np.int64)) if len(order) else np.zeros(0, np.int64)
    return learn([sets[i] for i in order], label_values[order] if len(order) else np.zeros(0))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted appended; columns of these names, in any case, are replaced, all others stay, whatever their names."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("score", "predicted")))
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            names[at] = "text"
            for part in _blocks(batch.rename_columns(names)):
                s = m.scores(part.column("text"))
                yield part.append_column("score", pa.array(s)).append_column("predicted", pa.array((s >= threshold).astype(np.int32)))

    numbered = StructType([StructField("text" if i == at else f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    schema = StructType([*numbered.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.toDF(*numbered.names).mapInArrow(run, schema).toDF(*docs.columns, "score", "predicted")
