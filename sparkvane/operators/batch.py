"""Exact top-k for batches of queries: matrix products rule pairs out, the scores themselves decide between the rest.

A product of a block of rows with a block of queries gives all similarities of the two but for rounding. Pairs that can't be among
the best k, by that and a bound on the rounding, are left out; the others are scored as the columns of ``functions.similarity``
score them, element by element from left to right in double precision. So scores, ranks and ties are those of the columns.

All pairs are compared, so the time grows with rows times queries. What a task holds doesn't: a block of queries and their best k, a
block of rows, and the ids of the rows that are among the best so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.similarity import EPSILON

#: Rows and queries of one product, pairs scored at a time, and ids held before those that are no longer needed go.
ROWS, QUERIES, PAIRS, HELD = 1024, 2048, 1 << 16, 1 << 19
#: Numbers that a block of queries may hold: its vectors, or its best k. The largest k for which blocks are of use.
BLOCK_NUMBERS, LARGEST_K = 1 << 22, 1 << 12


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of the rows of a and b, from left to right."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _unit(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Rows by their norms; zero rows stay, and rows whose norm is no usable number are NaN: nothing is ruled out for them."""
    usable, zero = np.isfinite(norm) & (norm > 1e-150), ~x.any(axis=1)
    out = x / np.where(usable, norm, 1.0)[:, None]
    out[~usable] = np.nan
    out[zero] = 0.0
    return out


@dataclass(frozen=True)
class Metric:
    """``prepared``: rows, given with their norms, whose products are at least the score, but for rounding. ``score``: of pairs (a, b, norms of a, norms of b)."""

    prepared: Callable[[np.ndarray, np.ndarray], np.ndarray]
    score: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


#: The metrics that are ruled out by products. A cosine is at most the product of the unit vectors (less, where norms are below EPSILON).
PRODUCTS = {
    "cosine": Metric(_unit, lambda a, b, na, nb: ordered_dot(a, b) / np.maximum(na * nb, EPSILON)),
    "dot": Metric(lambda x, norm: x, lambda a, b, na, nb: ordered_dot(a, b)),
}


def vectors(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places and the rows of the vectors. Vectors with a null have a length, but no place."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(at)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
        if flat.null_count:
            whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), d).any(axis=1)
            at, x = at[whole], x[whole]
        out[d] = at, x
    return out


class _Best:
    """The best k rows of each query so far: by score (NaN first, as Spark orders), then by place."""

    def __init__(self, queries: np.ndarray, k: int, least: float, metric: Metric) -> None:
        self.queries, self.k, self.least, self.metric = queries, k, least, metric
        n, d = queries.shape
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(ordered_dot(queries, queries))
            self.prepared = np.ascontiguousarray(metric.prepared(queries, self.norm).T)
            self.length = np.nan_to_num(np.sqrt((self.prepared**2).sum(axis=0)), nan=0.0, posinf=np.inf)
        self.error = 8 * (d + 16) * np.finfo(np.float64).eps
        self.score, self.place = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)

    def add(self, rows: np.ndarray, norm: np.ndarray | None, places: np.ndarray) -> None:
        """Further rows, with their norms if these are known; their places are above all earlier ones and ascend."""
        with np.errstate(all="ignore"):
            norm = np.sqrt(ordered_dot(rows, rows)) if norm is None else norm
            prepared = self.metric.prepared(rows, norm)
            length = np.nan_to_num(np.sqrt((prepared**2).sum(axis=1)), nan=0.0, posinf=np.inf).max(initial=0.0)
            for s in range(0, len(self.queries), QUERIES):
                self._add(rows, norm, prepared, length, places, s, min(s + QUERIES, len(self.queries)))

    def _add(self, rows: np.ndarray, norm: np.ndarray, prepared: np.ndarray, length: float, places: np.ndarray, start: int, end: int) -> None:
        bound = prepared @ self.prepared[:, start:end]
        room = self.place[start:end, -1] < 0
        if len(rows) > self.k and room.any():  # with the best by the bound in place, little is left to score
            first = np.argpartition(np.where(np.isnan(bound), np.inf, bound), -self.k, axis=0)[-self.k :].T
            low = np.empty((end - start, self.k))
            for s in range(0, end - start, max(1, PAIRS // self.k)):
                q = np.arange(s, min(s + max(1, PAIRS // self.k), end - start))
                low[q] = self._scores(rows, norm, first[q].ravel(), np.repeat(start + q, self.k)).reshape(len(q), -1)
            low = np.where(np.isnan(low), np.inf, low).min(axis=1)
        else:
            low = np.full(end - start, -np.inf)
        worst = np.where(np.isnan(self.score[start:end, -1]), np.inf, self.score[start:end, -1])
        slack = np.nan_to_num(self.error * length * self.length[start:end], nan=np.inf)
        bar = np.maximum(np.maximum(low, worst), self.least) - slack
        r, q = np.nonzero(~(bound < np.where(np.isnan(bar), -np.inf, bar)))
        for s in range(0, len(r), PAIRS):
            self._merge(rows, norm, r[s : s + PAIRS], start + q[s : s + PAIRS], places)

    def _scores(self, rows: np.ndarray, norm: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.metric.score(rows[r], self.queries[q], norm[r], self.norm[q])

    def _merge(self, rows: np.ndarray, norm: np.ndarray, r: np.ndarray, q: np.ndarray, places: np.ndarray) -> None:
        score = self._scores(rows, norm, r, q)
        worst, full = self.score[q, -1], self.place[q, -1] >= 0
        nan = np.isnan(score)
        good = nan | ((score > 0) & (score >= self.least))
        good &= ~full | (score > worst) | (nan & ~np.isnan(worst))  # of equal ones the earlier stays
        score, r, q = score[good], r[good], q[good]
        if not len(q):
            return
        changed = np.unique(q)
        held = np.repeat(changed, self.k)
        all_q = np.concatenate([held, q])
        all_score = np.concatenate([self.score[changed].ravel(), score])
        all_place = np.concatenate([self.place[changed].ravel(), places[r]])
        nan = np.isnan(all_score)
        order = np.lexsort((all_place, np.where(nan, 0.0, -all_score), ~nan, all_q))
        counts = np.bincount(np.searchsorted(changed, all_q), minlength=len(changed))
        at = order[(np.cumsum(counts) - counts)[:, None] + np.arange(self.k)]
        self.score[changed], self.place[changed] = all_score[at], all_place[at]


def search(batches: Iterator[pa.RecordBatch], query_ids: pa.Array, query_vectors: dict[int, tuple[np.ndarray, np.ndarray]], k: int, metric: str, min_score: float, strict: bool) -> Iterator[pa.RecordBatch]:
    """The best k rows (id, vector, norm if known) of these batches for each query, as (query_id, id, score). Of equal ones, the first in the batches' order."""
    best = {d: _Best(x, k, max(0.0, min_score), PRODUCTS[metric]) for d, (_, x) in query_vectors.items() if k > 0}
    ids: list[pa.Array] = []
    held, id_name = 0, "id"
    for batch in batches:
        id_name = batch.schema.names[0]
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            norm = pc.fill_null(part.column(2), 0.0).to_numpy(zero_copy_only=False).astype(np.float64) if part.num_columns > 2 else None  # no norm: EPSILON decides
            for d, (at, rows) in vectors(part.column(1)).items():
                if strict and any(d != other for other in query_vectors):
                    raise ValueError("vectors differ in length")
                if d in best and len(at):
                    best[d].add(rows, None if norm is None else norm[at], held + at)
            ids.append(part.column(0))
            held += part.num_rows
            if held > HELD and len(ids) > 1:
                needed = np.unique(np.concatenate([np.array([], np.int64), *[b.place[b.place >= 0] for b in best.values()]]))
                ids = [pa.concat_arrays(ids).take(pa.array(needed))]
                held = len(needed)
                for b in best.values():
                    b.place = np.where(b.place >= 0, np.searchsorted(needed, b.place), -1)
    for d, b in best.items() if ids else ():
        ids = [pa.concat_arrays(ids)]
        q, _ = np.nonzero(b.place >= 0)
        place, score = b.place[b.place >= 0], b.score[b.place >= 0]
        for s in range(0, len(q), 1 << 16):
            e = slice(s, s + (1 << 16))
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query_vectors[d][0][q[e]])), ids[0].take(pa.array(place[e])), pa.array(score[e])], ["query_id", id_name, "score"])
