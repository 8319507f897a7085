"""Hashed text features and the linear models fitted on them, for the toxicity and the quality classifiers.

Models are fitted on the driver with numpy on a bounded sample of labelled rows; scoring is a map over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .textops import U64, Tokens, chunks, mix, text_buffers

#: Number of hashed features, and the bound on labelled rows that a model is fitted on (chosen by hashed id).
DIMENSIONS, SAMPLE_ROWS = 1 << 20, 12_000
#: Steps of a fit at least: small samples are gone through more often.
LEAST_STEPS = 500
#: Rows of a class without which it isn't learnt.
LEAST_CLASS = 5


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document, as (indexes, n + 1 offsets).

    They are folded words, their first 5 and 7 bytes, the last 2 and 3 bytes of raw words, and the octave of the word count.
    """
    index, ends = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    base = 0
    for i, j in chunks(offs):
        raw, where = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        doc, value = [], []
        for fold in (True, False):
            t = Tokens(raw, where, fold)
            size = t.end - t.start
            kinds = [(5, 0), (7, 0)] if fold else [(0, 2), (0, 3)]
            if fold:
                doc.append(t.doc)
                value.append(t.hash)
            for head, tail in kinds:
                which = np.flatnonzero(size > max(head, tail))
                doc.append(t.doc[which])
                value.append(t.part(which, head, tail) + U64(head + 16 * tail))
            if not fold:
                doc.append(np.arange(j - i))
                value.append(mix(np.log2(np.diff(t.first) + 1).astype(np.int64).astype(U64) + U64(1 << 40)))
        key = (np.concatenate(doc).astype(U64) << U64(20)) | (np.concatenate(value) >> U64(44))
        key.sort()
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        key = key[fresh]
        index.append((key & U64(DIMENSIONS - 1)).astype(np.int64))
        ends.append(base + np.searchsorted(key >> U64(20), np.arange(1, j - i + 1)))
        base += len(key)
    return np.concatenate(index), np.concatenate(ends)


def sums(weights: np.ndarray, index: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's features."""
    total = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
    return total[offs[1:]] - total[offs[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def take(index: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse matrix of the given rows."""
    n = offs[rows + 1] - offs[rows]
    out = np.concatenate([[0], np.cumsum(n)])
    picked = np.empty(int(out[-1]), index.dtype)
    for s in range(0, len(rows), 256):
        e = min(s + 256, len(rows))
        at = np.repeat(offs[rows[s:e]] - out[s:e], n[s:e]) + np.arange(out[s], out[e])
        picked[out[s] : out[e]] = index[at]
    return picked, out


def sample(docs: DataFrame, labels: DataFrame, targets: dict[str, F.Column], rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Features and targets of at most ``rows`` labelled documents, in the order of their hashed ids.

    Labels with a null id or a null target, and ids without a document, are left out; of repeated labels for an id the
    least counts, of several documents with one id the text of least hash. The chosen ids are at most ``rows``, so their broadcast is bounded, and so
    is what reaches the driver.
    """
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(targets.values())]).dropna()
    names = [f"y{k}" for k in range(len(targets))]
    one = known.groupBy("id").agg(F.min(F.struct(*names)).alias("y")).select("id", "y.*")
    chosen = hashed_sample(one, rows, "id")
    text = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = text.join(F.broadcast(chosen), "id").groupBy("id", *names).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    joined = joined.select(F.xxhash64("id").alias("h"), *names, "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, offs = features(*text_buffers(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), *[batch.column(k) for k in names], lists], ["h", *names, "x"])

    table = joined.mapInArrow(run, "h long, " + ", ".join(f"{k} int" for k in names) + ", x array<int>").toArrow().combine_chunks()
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), {k: np.zeros(0, np.int64) for k in targets}
    lists = table.column("x").combine_chunks()
    y = {k: table.column(n).to_numpy()[order].astype(np.int64) for k, n in zip(targets, names, strict=True)}
    flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    return *take(flat, offs, order), y


class Adagrad:
    """Mini-batch Adagrad over sparse binary features and a few dense ones.

    Features of fewer than ``LEAST_ROWS`` rows keep weight 0: they say nothing about other texts. The others are renumbered, so
    that a step is a handful of passes over short dense arrays.
    """

    LEAST_ROWS = 3

    def __init__(self, index: np.ndarray, offs: np.ndarray, dense: np.ndarray, rate: float = 0.3, l2: float = 1e-3) -> None:
        rows = np.zeros(DIMENSIONS, np.int32)
        for s in range(0, len(index), 1 << 20):  # piecewise: the driver's memory is small
            rows += np.bincount(index[s : s + (1 << 20)], minlength=DIMENSIONS).astype(np.int32)
        used = rows >= self.LEAST_ROWS
        self.columns = np.flatnonzero(used)
        keep = used[index]
        self.index = (np.cumsum(used, dtype=np.int32) - 1)[index[keep]]
        self.offs = np.concatenate([[0], np.cumsum(keep)])[offs]
        self.dense, self.rate, self.l2 = dense, rate, l2
        self.w, self.v = np.zeros(len(self.columns)), np.zeros(dense.shape[1])
        self.gw, self.gv = np.full(len(self.w), 1e-2), np.full(len(self.v), 1e-2)

    def step(self, rows: np.ndarray, slope) -> None:
        """One step; ``slope(score)`` gives the loss's slope in the rows' scores."""
        x, o = take(self.index, self.offs, rows)
        d = self.dense[rows]
        s = slope(sums(self.w, x, o) + d @ self.v) / max(1, len(rows))
        g = np.bincount(x, weights=np.repeat(s, np.diff(o)), minlength=len(self.w)) + self.l2 * self.w
        self.gw += g * g
        self.w -= self.rate * g / np.sqrt(self.gw)
        g = d.T @ s
        self.gv += g * g
        self.v -= self.rate * g / np.sqrt(self.gv)

    def weights(self) -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        out[self.columns] = self.w
        return out


def rounds(n: int, epochs: int, batch: int) -> int:
    """Passes over n rows: ``epochs``, or more for ``LEAST_STEPS`` steps."""
    return max(epochs, -(-LEAST_STEPS // -(-n // batch)))


def fit_logistic(index: np.ndarray, offs: np.ndarray, dense: np.ndarray, y: np.ndarray, positive: float = 1.0, epochs: int = 10, batch: int = 128, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the hashed and of the dense features, a constant first among these; positives count ``positive`` times.

    With fewer than ``LEAST_CLASS`` rows of a class there is nothing to learn: a constant model of the other class; without
    rows, of the negative one.
    """
    n = len(y)
    dense = np.column_stack([np.ones(n), dense])
    model = Adagrad(index, offs, dense)
    if min(y.sum(), n - y.sum()) < LEAST_CLASS:
        model.v[0] = 8 if y.sum() > n - y.sum() else -8
        return model.weights(), model.v
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, positive, 1.0)
    for _ in range(rounds(n, epochs, batch)):
        order = rng.permutation(n)
        for s in range(0, n, batch):
            rows = order[s : s + batch]
            model.step(rows, lambda score, rows=rows: weight[rows] * (sigmoid(score) - y[rows]))
    return model.weights(), model.v
