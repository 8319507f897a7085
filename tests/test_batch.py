"""Batches of queries by products of blocks: the rows that pair-by-pair columns give, to the last bit."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkvane.operators import batch
from sparkvane.operators.collection import Collection

NAN, INF = float("nan"), float("inf")
ODD = [[0.0, 0.0, 0.0], [NAN, 1.0, 0.0], [INF, 1.0, 1.0], None, [1.0, None, 2.0], [1e-30, 1e-30, 0.0], [3e-9, 0.0, 1e-9], [1e30, 1e30, -1e30], [-1.0, -2.0, -3.0], [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [1.0, 2.0, 3.0]]


def plain(rows, queries, k, metric="cosine"):
    """(query_id, id, score) of the best k, with rows in order of id."""
    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    out = []
    for query_id, q in queries:
        scored = []
        for i, v in rows:
            if v is None or q is None or None in v or None in q or len(v) != len(q):
                continue
            s = dot(v, q)
            if metric == "cosine":
                below = math.sqrt(dot(v, v)) * math.sqrt(dot(q, q))
                below = below if math.isnan(below) else max(below, 1e-8)
                s = 0.0 if math.isinf(below) and math.isfinite(s) else s / below
            if math.isnan(s) or s > 0:
                scored.append(((not math.isnan(s), 0.0 if math.isnan(s) else -s, i), s))
        out += [(query_id, key[2], repr(s)) for key, s in sorted(scored)[:k]]
    return sorted(out)


def found(rows, queries, k, metric="cosine", size=7):
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
    ids, asked = pa.array([q[0] for q in queries], pa.int64()), batch.vectors(pa.array([q[1] for q in queries], pa.list_(pa.float64())))
    out = batch.search(iter(table.to_batches(max_chunksize=size)), ids, asked, k, metric, 0.0, False)
    return sorted((q, i, repr(s)) for b in out for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True))


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_products_give_what_pairs_give(monkeypatch, metric):
    rng = np.random.default_rng(3)
    near = [[float(x) for x in v] for v in rng.integers(-2, 3, (120, 3))]  # many ties
    wide = [[float(x) for x in v] for v in rng.normal(size=(60, 5)).astype(np.float32)]
    rows = list(enumerate([*near[:50], *ODD, *wide, *near[50:], *near[:20]]))
    queries = rows[::3] + [(1000 + i, v) for i, v in enumerate(ODD)]
    for name, small in (("ROWS", 16), ("QUERIES", 8), ("PAIRS", 11), ("HELD", 40)):
        monkeypatch.setattr(batch, name, small)
    for k in (1, 4, 30, 500):
        assert found(rows, queries, k, metric) == plain(rows, queries, k, metric)


def test_few_pairs_are_scored(monkeypatch):
    x = np.random.default_rng(4).normal(size=(20_000, 8))
    count, scores = [0], batch._Best._scores
    monkeypatch.setattr(batch._Best, "_scores", lambda self, rows, norm, r, q: (count.__setitem__(0, count[0] + len(r)), scores(self, rows, norm, r, q))[1])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert len(found(rows, rows[::100], 5, size=10_000)) == 1000
    assert count[0] < 0.02 * 20_000 * 200


def test_no_pair_goes_through_a_join(spark):
    df = spark.createDataFrame([(f"{i:03d}"[::-1], [float(i % 7), float(i % 3), -1.0], float(i % 5)) for i in range(300)] + [(f"x{i:02d}", v, None) for i, v in enumerate(ODD)], "doc_id string, v array<float>, norm double")
    asked = df.where("doc_id LIKE '%1' OR doc_id LIKE 'x%'").select(F.col("doc_id").alias("query_id"), F.col("v").alias("vector"))
    for norms, metric in itertools.product(({}, {"v": "norm"}), ("cosine", "dot")):
        c = Collection(df, norms=norms)
        got = c.search_batch(asked, "v", 6, metric=metric, min_score=0.1, on_mismatch="skip")
        assert "NestedLoopJoin" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
        with pytest.MonkeyPatch.context() as m:
            m.setattr(batch, "LARGEST_K", 0)  # pair by pair
            want = c.search_batch(asked, "v", 6, metric=metric, min_score=0.1, on_mismatch="skip")
        assert want.schema.simpleString() == got.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert Collection(df).search_batch(asked.where("false"), "v", 6).count() == Collection(df).search_batch(asked, "v", 0).count() == 0
