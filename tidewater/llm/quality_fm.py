"""Quality classifier: a factorisation machine (operator 6).

score = sigmoid(w0 + sum_j w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise sum computed in linear time as
half of sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2). Inputs x: hashed words (share of the text's words),
structure statistics (shares of upper-case, symbol, repeated words, of repeated lines, length) and metadata
(the stored length ``n_chars``, where there is such a column). Labels, language, source and ids are never inputs.

The machine is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``; of repeated rows of one id the one of the
smallest text and ``n_chars``); scoring reads every whole text.

Defined results: a null or empty text is scored from its statistics alone; a null ``n_chars`` counts as 0;
repeated rows get equal scores; without labels of both kinds every score is the share of good labels (0.5
without any); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import FEATURES as LINE_FEATURES
from .quality_rules import measure, one_each
from .words import Words, mix, slices, text_column

#: The most labelled rows that the machine is fitted on.
TRAIN_ROWS = 4000
BUCKETS, RANK = 1 << 14, 4
STATS = 16


def features(part: pa.RecordBatch, text: str = "text", chars: str = "n_chars") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, input numbers and values of the texts, as a sparse matrix by rows."""
    texts = text_column(part, text)
    w, (counts, x, size, doc) = Words(texts), measure(texts)
    n = np.maximum(counts["n_words"], 1)
    # hashed words: one entry for each bucket of a document
    key = w.doc.astype(np.int64) * BUCKETS + (mix(w.hashes() ^ np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64)
    key, c = np.unique(key, return_counts=True)
    row, col = key // BUCKETS, key % BUCKETS
    value = c / np.sqrt(n[row])
    distinct = np.bincount(row, minlength=part.num_rows) / n
    lines = np.maximum(np.bincount(doc, minlength=part.num_rows), 1)
    mean = [np.bincount(doc, x[:, k] * size, part.num_rows) / n for k in range(2, len(LINE_FEATURES))]
    meta = part.column(part.schema.get_field_index(chars)).fill_null(0).to_numpy(zero_copy_only=False) if chars in part.schema.names else np.zeros(part.num_rows)
    stats = np.stack([np.log1p(counts["n_words"]) / 8, distinct, counts["n_repeat_words"] / n, np.minimum(counts["n_symbols"] / n, 3), counts["n_dup_lines"] / lines, counts["word_chars"] / n / 8, *mean, np.log1p(np.maximum(meta, 0)) / 10], 1)
    stats = np.pad(stats, ((0, 0), (0, STATS - stats.shape[1])))
    own = np.full(part.num_rows, STATS) + np.bincount(row, minlength=part.num_rows)
    start = np.concatenate([[0], np.cumsum(own)])
    cols, values = np.empty(start[-1], np.int32), np.empty(start[-1], np.float32)
    head = (start[:-1, None] + np.arange(STATS)).ravel()
    rest = np.ones(start[-1], bool)
    rest[head] = False
    cols[head], values[head] = np.tile(np.arange(STATS) + BUCKETS, part.num_rows), stats.ravel()
    cols[rest], values[rest] = col, value
    return start, cols, values


class Machine:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(BUCKETS + STATS, np.float32)
        self.v = rng.normal(0, 0.01, (BUCKETS + STATS, RANK)).astype(np.float32)

    def raw(self, start: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the sigmoid, and the sums by factor. Every row has entries (the statistics)."""
        xv = values[:, None] * self.v[cols]
        s = np.add.reduceat(xv, start[:-1], axis=0)
        squares = np.add.reduceat((xv * xv).sum(1), start[:-1])
        return self.w0 + np.add.reduceat(values * self.w[cols], start[:-1]) + 0.5 * ((s * s).sum(1) - squares), s

    def score(self, start: np.ndarray, cols: np.ndarray, values: np.ndarray) -> np.ndarray:
        if len(start) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(start, cols, values)[0].astype(np.float64), -30, 30)))

    def fit(self, start: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.05, ridge: float = 1e-4) -> Machine:
        """Logistic loss, both kinds of label weighing the same, by Adam over the whole sample."""
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.5
            self.w0, self.v[:] = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)), 0
            return self
        weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean())
        row = np.repeat(np.arange(len(y)), np.diff(start))
        params = [np.zeros(1, np.float32), self.w, self.v]
        m, u = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, rounds + 1):
            self.w0 = float(params[0][0])
            raw, s = self.raw(start, cols, values)
            d = (weight * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(y)).astype(np.float32)
            dx = d[row] * values
            g = [np.array([d.sum()], np.float32), np.bincount(cols, dx, len(self.w)).astype(np.float32) + ridge * self.w]
            dv = dx[:, None] * (s[row] - values[:, None] * self.v[cols])
            g.append(np.stack([np.bincount(cols, dv[:, f], len(self.w)) for f in range(RANK)], 1).astype(np.float32) + ridge * self.v)
            for p, a, b, x in zip(params, m, u, g, strict=True):
                a += 0.1 * (x - a)
                b += 0.01 * (x * x - b)
                p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
        self.w0 = float(params[0][0])
        return self


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on the ``train_rows`` labelled documents of smallest hash. ``labels``: doc_id, quality, already
    without the rows that are held out."""
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = one_each(docs.select("doc_id", *_inputs(docs)).join(F.broadcast(some), "doc_id"))  # train_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                start, cols, values = features(part)
                cut = list(zip(start[:-1], start[1:], strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(part.num_columns - 1).cast(pa.int32()), pa.array([cols[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([values[a:b].tobytes() for a, b in cut], pa.binary())], names=["doc_id", "quality", "cols", "vals"])

    got = sorted(rows.mapInArrow(run, "doc_id long, quality int, cols binary, vals binary").collect())
    if not got:
        return Machine().fit(np.zeros(1, int), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0))
    cols = [np.frombuffer(r["cols"], np.int32) for r in got]
    start = np.concatenate([[0], np.cumsum([len(c) for c in cols])])
    return Machine().fit(start, np.concatenate(cols), np.concatenate([np.frombuffer(r["vals"], np.float32) for r in got]), np.array([float(r["quality"] > 0) for r in got]))


def _inputs(docs: DataFrame) -> list:
    return [F.col("text").cast("string").alias("text"), *([F.col("n_chars").cast("double").alias("n_chars")] if "n_chars" in docs.columns else [])]


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted. Narrow: no shuffle; one row in, one row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = machine.score(*features(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", *_inputs(docs)).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
