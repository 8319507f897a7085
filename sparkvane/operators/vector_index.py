"""Approximate vector search by inverted lists.

Centroids come from spherical k-means on a bounded sample; every vector belongs to the list of its nearest centroid. A query reads the
``nprobe`` lists whose centroids are nearest, and ranks their vectors exactly. With ``nprobe = nlist`` the result is exact.

Unless it is given, ``nprobe`` is measured when the index is built: the fewest lists that hold ``RECALL`` of the best k others of
some vectors of the sample. The sample is sparser than the table, so its neighbours are farther away and need no fewer lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import Similar
from .collection import Collection

SAMPLE_ROWS, ITERATIONS = 20_000, 12
#: Answers of at most so many rows come from the one job that finds them.
LOCAL_ROWS = 10_000
#: Share of the best k that the lists probed must hold in the sample, the vectors it is measured on, and the k it is measured for.
RECALL, MEASURED_ROWS, MEASURED_K = 0.95, 500, (1, 10, 100, 1000)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 5) -> np.ndarray:
    """Unit centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    x = _unit(x.astype(np.float64))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(iterations):
        nearest = np.concatenate([(x[s : s + 1024] @ c.T).argmax(axis=1) for s in range(0, len(x), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        empty = np.bincount(nearest, minlength=len(c)) == 0
        total[empty] = c[empty]
        c = _unit(total)
    return c


def measured_probes(x: np.ndarray, centroids: np.ndarray) -> list[int]:
    """For each of ``MEASURED_K``, the fewest lists that hold ``RECALL`` of the best k others of the first rows of x; all lists where x has too few rows."""
    x, nlist = _unit(x.astype(np.float64)), len(centroids)
    list_of = (x @ centroids.T).argmax(axis=1)
    found = np.zeros((len(MEASURED_K), nlist), np.int64)  # true neighbours by the place of their list in the query's order
    for s in range(0, min(MEASURED_ROWS, len(x)), 100):
        q = np.arange(s, min(s + 100, MEASURED_ROWS, len(x)))
        score = x[q] @ x.T
        score[np.arange(len(q)), q] = -np.inf
        place = np.argsort(np.argsort(-(x[q] @ centroids.T), axis=1, kind="stable"), axis=1)
        for i, k in enumerate(MEASURED_K):
            if k < len(x):
                best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                found[i] += np.bincount(np.take_along_axis(place, list_of[best], 1).ravel(), minlength=nlist)
    share = np.cumsum(found, axis=1) / np.maximum(found.sum(axis=1, keepdims=True), 1)
    return [int(np.argmax(r >= RECALL)) + 1 if r[-1] else nlist for r in share]


class VectorIndex:
    """``lists`` holds the documents with the number of their list in ``list_id``; -1 for documents without a vector. ``probes``: lists to read by ``MEASURED_K``."""

    def __init__(self, lists: DataFrame, centroids: np.ndarray, field: str, id_col: str, probes: Sequence[int] = ()) -> None:
        self.lists, self.centroids, self.field, self.id_col, self.probes = lists, centroids, field, id_col, tuple(probes)

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    @classmethod
    def build(cls, df: DataFrame, field: str, id_col: str = "doc_id", nlist: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """``nlist`` defaults to the square root of the number of vectors, and is at most the size of the sample: rows chosen by hashed id, ``sample_rows`` at most."""
        usable = df.where(F.size(field) > 0)
        n = usable.count()
        nlist = nlist or max(1, round(n**0.5))
        if n > sample_rows:  # a filter by hash, so that no more than the sample meets anywhere
            share = max(sample_rows - 4 * sample_rows**0.5, 1) / n
            usable = usable.where(F.shiftrightunsigned(F.xxhash64(id_col), 1) < F.lit(int(share * (1 << 63)))).limit(sample_rows)
        rows = usable.select(field).toArrow()
        if not rows.num_rows:
            raise ValueError("no vectors to index")
        x = np.array(rows.column(0).to_pylist(), dtype=np.float64)
        centroids = spherical_kmeans(x, nlist)
        return cls(_assign(df, field, centroids), centroids, field, id_col, measured_probes(x, centroids))

    def write(self, path: str) -> VectorIndex:
        """One folder for each list, so that a query's lists are the only ones read."""
        spark = self.lists.sparkSession
        self.lists.repartition("list_id").write.partitionBy("list_id").parquet(f"{path}/lists")
        rows = [(i, [float(v) for v in c], list(self.probes)) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "list_id int, centroid array<double>, probes array<int>").coalesce(1).write.parquet(f"{path}/centroids")
        return VectorIndex.read(spark, path, self.field, self.id_col)

    @classmethod
    def read(cls, spark: SparkSession, path: str, field: str, id_col: str = "doc_id") -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
        probes = rows[0]["probes"] if "probes" in rows[0] else ()  # an index without them is searched exactly
        return cls(spark.read.parquet(f"{path}/lists"), np.array([r["centroid"] for r in rows]), field, id_col, probes)

    def nprobe(self, k: int) -> int:
        """The lists that a search for the best ``k`` reads; all for a k beyond those measured."""
        return next((n for m, n in zip(MEASURED_K, self.probes, strict=False) if m >= k), self.nlist)

    def probe(self, vector: Sequence[float], nprobe: int) -> list[int]:
        """The lists nearest to a vector."""
        if len(vector) != self.centroids.shape[1]:
            raise ValueError(f"vectors differ in length: {len(vector)} and {self.centroids.shape[1]}")
        score = self.centroids @ _unit(np.asarray(vector, dtype=np.float64))
        return [int(i) for i in np.lexsort((np.arange(self.nlist), -score))[:nprobe]]

    def candidates(self, vector: Sequence[float], nprobe: int) -> DataFrame:
        return self.lists.where(F.col("list_id").isin(self.probe(vector, nprobe))).drop("list_id")

    def search(self, vector: Sequence[float], k: int, nprobe: int | None = None, where: F.Column | None = None, blend_match_all: bool = False) -> DataFrame:
        """The best ``k`` of the lists probed, by score and id.

        Without ``nprobe`` as many lists are read as the recall measured asks for; with a filter, for which none was measured, all.
        With a filter, or too few hits, more lists are read (twice as many each time) until k are found or all lists are read, so a
        filter never hides matches. ``blend_match_all`` gives scores as the mean of the similarity and 1. Documents
        with a similarity of 0 or less are left out.
        """
        if nprobe is None:
            nprobe = self.nprobe(k) if where is None else self.nlist
        probes = max(1, nprobe)
        while True:
            found = self.candidates(vector, probes)
            found = found if where is None else found.where(where)
            hits = Collection(found, self.id_col).search(Similar(self.field, tuple(vector)), k)
            if probes >= self.nlist:
                break
            if k <= LOCAL_ROWS:  # the answer itself tells whether it is complete: one job, not one to count and one to fetch
                rows = hits.toArrow()
                hits = self.lists.sparkSession.createDataFrame(rows, hits.schema) if rows.num_rows else hits.limit(0)
                if rows.num_rows >= k:
                    break
            elif hits.count() >= k:
                break
            probes *= 2
        return hits.withColumn("score", (F.col("score") + 1) / 2) if blend_match_all else hits

    def add(self, docs: DataFrame) -> VectorIndex:
        """With further documents in the lists of their nearest centroids; they replace those of equal id. The centroids stay."""
        kept = self.remove(docs.select(self.id_col)).lists
        return VectorIndex(kept.unionByName(_assign(docs, self.field, self.centroids), allowMissingColumns=True), self.centroids, self.field, self.id_col, self.probes)

    def remove(self, ids: DataFrame) -> VectorIndex:
        """Without the documents of the given ids; unknown ids are no error."""
        gone = ids.select(F.col(ids.columns[0]).alias(self.id_col)).distinct()
        return VectorIndex(self.lists.join(gone, self.id_col, "left_anti").select(*self.lists.columns), self.centroids, self.field, self.id_col, self.probes)

    def recall(self, vectors: Sequence[Sequence[float]], k: int, nprobe: int | None = None) -> float:
        """Share of the exact best k that the index finds, over the given queries."""
        hit = total = 0
        everything = Collection(self.lists.drop("list_id"), self.id_col)
        for v in vectors:
            exact = {r[0] for r in everything.search(Similar(self.field, tuple(v)), k, fields=[]).collect()}
            hit += len(exact & {r[0] for r in self.search(v, k, nprobe).select(self.id_col).collect()})
            total += len(exact)
        return hit / max(1, total)


def _assign(df: DataFrame, field: str, centroids: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    place = df.columns.index(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            nearest = np.full(len(batch), -1, np.int32)
            column = batch.column(place)
            sizes = np.array([-1 if s is None else s for s in pa.compute.list_value_length(column).to_pylist()])
            ok = np.flatnonzero(sizes == c.shape[1])
            if len(ok):
                x = column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
                nearest[ok] = (_unit(x.astype(np.float64)) @ c.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], [*batch.schema.names, "list_id"])

    import pyarrow.compute  # noqa: F401

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("list_id", T.IntegerType())]))
