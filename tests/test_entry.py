"""Every registered query runs at the smallest scale, and agrees with its SQL."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from sparkvane.operators.collection import Collection
from sparkvane.operators.vector_index import VectorIndex

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


def test_entry(spark):
    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    df = e.queries()[name](spark, DATA)
    rel = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in rel.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(e.queries()) - set(e.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert e.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ann_topk_recall_on_the_tables(spark, sf):
    """Every row as a query: what its lists hold of the exact best 10. The registered query against brute force."""
    d = f"/root/testdata/{sf}"
    index = VectorIndex.build(spark.read.parquet(f"{d}/embeddings.parquet"), "embedding", "vec_id")
    rows = index.lists.select("vec_id", "embedding", "list_id").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    list_of, ids = np.array([r["list_id"] for r in rows]), [r["vec_id"] for r in rows]
    best = np.argsort(-(x @ x.T), axis=1)[:, :10]
    kept = [np.isin(list_of[b], index.probe(v, index.nprobe(10))) for v, b in zip(x, best)]
    assert np.mean(kept) >= 0.9 and index.nprobe(10) < index.nlist
    found = {r["vec_id"] for r in e.queries()["ann_topk"](spark, d).collect()}
    assert {ids[b] for b, k in zip(best[ids.index(0)], kept[ids.index(0)]) if k} <= found
    assert len(found & {ids[b] for b in best[ids.index(0)]}) >= 9


def test_batches_of_queries_are_cut_into_blocks(spark, monkeypatch):
    e_ = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = e_.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = Collection(e_, "vec_id")
    whole = c.search_batch(asked, "embedding", 3).collect()
    monkeypatch.setattr("sparkvane.operators.collection.BROADCAST_QUERIES", 100)
    assert sorted(c.search_batch(asked, "embedding", 3).collect()) == sorted(whole) and len(whole) == 1500
    with pytest.raises(Exception, match="differ in length"):
        c.search_batch(asked.withColumn("vector", F.slice("vector", 1, 5)), "embedding", 3).collect()
