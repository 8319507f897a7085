"""Quality by ordinal regression with cumulative links.

Documents carry an ordered grade: 0 for low quality, 1 for good but toxic, 2 for good. One weight per hashed text feature is
shared by all grades; ordered thresholds t1 < t2 give the tails P(grade >= k) = sigmoid(w x - t_k). The expected
grade is the sum of the tails. The model is fitted on a bounded sample of labelled rows; every document is scored.

``selected`` holds where P(grade is the highest) is over one half, so neither low quality nor toxic texts are.

Nulls and edge cases: a null or empty text is scored as a text without features; very long texts are scored whole; null labels are left out; without labels every tail is
an uninformed constant, and nothing is selected. Every row is scored, repeated ones and ties alike; ids may be null, repeated or of any type; of several labels for
an id the least counts. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type
from .linear import SAMPLE_ROWS, Adagrad, features, rounds, sample, sigmoid, sums
from .textops import text_buffers

GRADE, GRADES = "case when quality = 0 then 0 when toxic = 1 then 1 else 2 end", 3


class Ordinal:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, index: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """P(grade >= k), one column for each k from 1."""
        return sigmoid(sums(self.weights, index, offs)[:, None] - self.thresholds[None, :])


def fit(index: np.ndarray, offs: np.ndarray, grade: np.ndarray, grades: int = GRADES, epochs: int = 12, batch: int = 128, seed: int = 1) -> Ordinal:
    """Maximum likelihood by mini-batch Adagrad. Thresholds are t1 and the logarithms of the steps, so they stay ordered."""
    n = len(grade)
    tail = np.array([np.clip((grade >= k).mean() if n else 0.5, 1e-3, 1 - 1e-3) for k in range(1, grades)])
    t = np.sort(-np.log(tail / (1 - tail)) + 1e-3 * np.arange(grades - 1))
    model = Adagrad(index, offs, np.zeros((n, 0)))
    if n == 0 or grade.min() == grade.max():
        return Ordinal(model.weights(), t)
    free = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    squares = np.full(grades - 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(rounds(n, epochs, batch)):
        order = rng.permutation(n)
        for s in range(0, n, batch):
            rows = order[s : s + batch]
            y = grade[rows]
            steps = np.concatenate([[free[0]], np.exp(free[1:])])
            edges = np.concatenate([[-np.inf], np.cumsum(steps), [np.inf]])
            slopes = np.zeros((len(rows), grades - 1))

            def slope(score: np.ndarray, y=y, edges=edges, slopes=slopes) -> np.ndarray:
                upper, lower = sigmoid(edges[y + 1] - score), sigmoid(edges[y] - score)  # P(grade <= y), P(grade < y)
                mass = np.maximum(upper - lower, 1e-9)
                du, dl = upper * (1 - upper) * np.isfinite(edges[y + 1]), lower * (1 - lower) * np.isfinite(edges[y])
                for k in range(grades - 1):
                    slopes[:, k] = -((y == k) * du - (y == k + 1) * dl) / mass
                return (du - dl) / mass

            model.step(rows, slope)
            g = slopes.mean(axis=0)
            g = np.array([g.sum(), *(g[k:].sum() * steps[k] for k in range(1, grades - 1))])
            squares += g * g
            free -= 0.3 * g / np.sqrt(squares)
    return Ordinal(model.weights(), np.cumsum(np.concatenate([[free[0]], np.exp(free[1:])])))


def fit_quality(docs: DataFrame, labels: DataFrame, grade: str = GRADE, grades: int = GRADES, rows: int = SAMPLE_ROWS) -> Ordinal:
    """The model fitted on at most ``rows`` labelled documents; ``grade`` is an expression over ``labels``, from 0 to ``grades`` - 1."""
    index, offs, y = sample(docs, labels, {"grade": F.expr(grade)}, rows)
    return fit(index, offs, y["grade"], grades)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, expected_grade, p_ge_1, p_ge_2, ..., selected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_ge_{k + 1}" for k in range(len(model.thresholds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.tails(*features(*text_buffers(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(p.sum(axis=1), 6)), *[pa.array(np.round(c, 6)) for c in p.T], pa.array(p[:, -1] > 0.5)], ["doc_id", "expected_grade", *names, "selected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, expected_grade double, " + ", ".join(f"{n} double" for n in names) + ", selected boolean")
