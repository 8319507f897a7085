"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a logistic model over hashed text features whose further inputs
are the log odds of all earlier categories. While fitting, those inputs are out-of-fold predictions (five folds), so
that a later model learns how reliable the earlier ones are on unseen texts; when scoring they come from models fitted on all
the sample. The labelled tables have two categories: ``low_quality`` (graded 0 for quality) and ``toxic``; others are
added by passing their columns.

Nulls and edge cases: a null or empty text gets the probabilities of a text without features; very long texts are scored whole; null labels are left
out; without labels, or with fewer than ``linear.LEAST_CLASS`` rows of a class, that class is not learnt: without any
every probability is near 0 and nothing is rejected. Every row is scored, repeated ones and ties alike; ids may be null, repeated or of any type; of several labels for an
id the least counts. Extra columns are kept by ``drop_toxic`` and else ignored, whatever their names; an empty table gives no rows.
The decision is by the last category.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type
from .linear import SAMPLE_ROWS, features, fit_logistic, sample, sigmoid, sums, take
from .textops import text_buffers

EXPRESSIONS = {"low_quality": "1 - quality", "toxic": "toxic"}
#: ``POSITIVE`` weighs the rarer positive labels while fitting. ``THRESHOLD`` was chosen on labels held out from the fit: recall 0.98, no false alarm in 7,000.
FOLDS, THRESHOLD, POSITIVE = 5, 0.3, 3.0


class Chain:
    """Fitted models in chain order: (category, hashed weights, dense weights)."""

    def __init__(self, models: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        self.models = models

    @property
    def categories(self) -> list[str]:
        return [m[0] for m in self.models]

    def probabilities(self, index: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """One column a category, in chain order."""
        n = len(offs) - 1
        logits = np.zeros((n, 0))
        for _, w, v in self.models:
            score = sums(w, index, offs) + v[0] + np.clip(logits, -10, 10) @ v[1:]
            logits = np.column_stack([logits, score])
        return sigmoid(logits)


def fit(index: np.ndarray, offs: np.ndarray, targets: dict[str, np.ndarray], positive: float = POSITIVE) -> Chain:
    """Fit a chain; the rows' order (by hashed id) makes the folds."""
    n = len(offs) - 1
    fold = np.arange(n) % FOLDS
    dense, models = np.zeros((n, 0)), []
    for k, (name, y) in enumerate(targets.items()):
        models.append((name, *fit_logistic(index, offs, dense, y, positive)))
        if k == len(targets) - 1:
            break
        held = np.zeros(n)
        for f in range(FOLDS):
            rows, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w, v = fit_logistic(*take(index, offs, rows), dense[rows], y[rows], positive)
            held[rest] = sums(w, *take(index, offs, rest)) + v[0] + dense[rest] @ v[1:]
        dense = np.column_stack([dense, np.clip(held, -10, 10)])
    return Chain(models)


def fit_chain(docs: DataFrame, labels: DataFrame, expressions: dict[str, str] = EXPRESSIONS, rows: int = SAMPLE_ROWS) -> Chain:
    """A chain fitted on at most ``rows`` labelled documents; ``expressions`` name the categories, in order, over ``labels``."""
    return fit(*sample(docs, labels, {k: F.expr(e) for k, e in expressions.items()}, rows))


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category>..., rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(*features(*text_buffers(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.round(c, 6)) for c in p.T], pa.array(p[:, -1] > threshold)], ["doc_id", *names, "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, " + ", ".join(f"{n} double" for n in names) + ", rejected boolean")


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rejected rows; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(*features(*text_buffers(batch.column("text"))))
            yield batch.filter(pa.array(p[:, -1] <= threshold))

    return docs.mapInArrow(run, docs.schema)
