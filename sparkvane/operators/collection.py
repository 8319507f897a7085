"""A collection of documents: a DataFrame with an id column, searched, changed and counted."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import METRICS, norm_of
from ..plans.compiler import Compiler, kind_of
from ..plans.query import Query, QueryBuilder
from ..sources.documents import unify
from . import batch

#: Rows of a query batch that are broadcast at a time; larger batches are cut into blocks of about so many. Without products of blocks, as many of these at most.
BROADCAST_QUERIES, BROADCAST_PAIRED = 65536, 4096


class Collection:
    """Documents are rows; a missing field is null. Methods that change it return a new collection: DataFrames are immutable.

    ``telemetry`` is called as ``telemetry(metric, value)`` around searches and changes.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", norms: dict[str, str] | None = None, telemetry: Callable[[str, float], None] | None = None) -> None:
        if id_col not in df.columns:
            raise ValueError(f"no id column {id_col!r}")
        self.df, self.id_col, self.norms, self.telemetry = df, id_col, norms or {}, telemetry

    @staticmethod
    def query() -> QueryBuilder:
        return QueryBuilder()

    def _with(self, df: DataFrame) -> Collection:
        return Collection(df, self.id_col, self.norms, self.telemetry)

    def _record(self, metric: str, value: float) -> None:
        if self.telemetry:
            self.telemetry(metric, value)

    def _scored(self, query: Query | QueryBuilder, scoring: str, options: dict[str, Any]) -> tuple[DataFrame, bool]:
        """Documents with their ``score``, and whether those without a positive one are still among them."""
        query = query.build() if isinstance(query, QueryBuilder) else query
        c = Compiler(self.df.schema, scoring, norms=self.norms, **options).compile(query)
        df = self.df if c.necessary is None else self.df.where(c.necessary)
        if scoring == "geometric" and not c.exact:
            df = df.where(c.hit)
        return df.withColumn("score", c.score.cast("double")), scoring == "mean" and not c.exact

    def scored(self, query: Query | QueryBuilder, scoring: str = "mean", **options: Any) -> DataFrame:
        """All hits with their ``score``, unordered.

        The necessary condition is a filter of its own below the score's projection, so it reaches the scan.
        """
        df, open_ = self._scored(query, scoring, options)
        return df.where("score > 0") if open_ else df

    def search(self, query: Query | QueryBuilder, k: int | None = None, fields: Sequence[str] | None = None, min_score: float | None = None, scoring: str = "mean", **options: Any) -> DataFrame:
        """The best ``k`` hits (all, if None), by score descending and id: a top-k, not a sort, when k is given.

        A bound on the score commutes with the top-k, so it is applied after it; below, Catalyst would work out the score twice.
        """
        if k is not None and k < 0:
            raise ValueError("k must not be negative")
        df, open_ = self._scored(query, scoring, options)
        if fields is not None:
            df = df.select(self.id_col, *[f for f in fields if f != self.id_col], "score")
        order = [F.col("score").desc(), F.col(self.id_col).asc()]
        if k is not None:
            df = df.orderBy(*order).limit(k)
        if open_:
            df = df.where("score > 0")
        if min_score is not None:
            df = df.where(F.col("score") >= min_score)
        self._record("search.count", 1)
        return df if k is not None else df.orderBy(*order)

    def hits(self, query: Query | QueryBuilder, k: int, **options: Any) -> list[Row]:
        """The rows of ``search``, found now: the time that takes is recorded as the search's latency."""
        began = time.perf_counter()
        rows = self.search(query, k, **options).collect()
        self._record("search.latency", time.perf_counter() - began)
        return rows

    def search_batch(self, queries: DataFrame, field: str, k: int, query_id: str = "query_id", vector: str = "vector", metric: str = "cosine", min_score: float = 0.0, on_mismatch: str = "error") -> DataFrame:
        """The best ``k`` documents of a positive score of at least ``min_score`` for each row of ``queries``: (query_id, id, score, rank).

        As in ``search``, vectors of another length are an error, or no match with ``on_mismatch="skip"``. All pairs are compared: for cosine and
        dot by products of blocks of rows and queries, which find each partition's best k; for other measures, or a k above ``LARGEST_K``,
        pair by pair. All documents are read once for each block of queries.
        """
        if kind_of(self.df.schema[field].dataType) != "vector":
            raise ValueError(f"{field!r} is not a vector field")
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("__query"))
        products = metric in batch.PRODUCTS and k <= batch.LARGEST_K
        n, length = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("__query")), F.lit(0))).first()
        at_once = min(BROADCAST_QUERIES, max(1, batch.BLOCK_NUMBERS // max(length, k, 1)) if products else BROADCAST_PAIRED)
        blocks = max(1, -(-n // at_once))
        data = self.df.select(F.col(self.id_col), F.col(field).alias("__data"), *([F.col(self.norms[field]).cast("double").alias("__norm")] if field in self.norms else []))
        # Rows cost far more to compare than to move: a table in few files is spread evenly over all cores first.
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        if data.rdd.getNumPartitions() < 4 * cores:
            data = data.repartition(2 * cores)
        found_in = (self._products if products else self._paired)(data, k, metric, min_score, on_mismatch)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.id_col))
        found = None
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
            best = found_in(part).withColumn("rank", rank).where(F.col("rank") <= k)
            found = best if found is None else found.union(best)
        return found

    def _products(self, data: DataFrame, k: int, metric: str, min_score: float, on_mismatch: str) -> Callable[[DataFrame], DataFrame]:
        """Gives (query_id, id, score) of every partition's best k for a block of queries. Partitions are sorted by id, as equal scores are ranked by it."""
        sc, strict = data.sparkSession.sparkContext, on_mismatch == "error"
        data = data.sortWithinPartitions(F.col(self.id_col).asc())
        id_field = data.schema[self.id_col]

        def found_in(part: DataFrame) -> DataFrame:
            rows = part.toArrow()
            ids = rows.column(0).combine_chunks()
            shared = sc.broadcast((ids, batch.vectors(rows.column(1))))
            schema = T.StructType([part.schema["query_id"], T.StructField(id_field.name, id_field.dataType), T.StructField("score", T.DoubleType())])
            return data.mapInArrow(lambda batches: batch.search(batches, *shared.value, k, metric, min_score, strict), schema)

        return found_in

    def _paired(self, data: DataFrame, k: int, metric: str, min_score: float, on_mismatch: str) -> Callable[[DataFrame], DataFrame]:
        """Gives (query_id, id, score) of all pairs for a block of queries; a row number below k per query lets Spark keep only k rows of each query in every partition before the shuffle."""
        if "__norm" not in data.columns:  # norms are worked out once a row, not once a pair
            data = data.withColumn("__norm", norm_of(F.col("__data")))
        score = METRICS[metric](F.col("__data"), F.col("__query"), "float64", F.col("__norm"), F.col("__query_norm"))
        if on_mismatch == "error":
            other = F.size("__data") != F.size("__query")
            score = F.when(other, F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(score)

        def found_in(part: DataFrame) -> DataFrame:
            pairs = data.crossJoin(F.broadcast(part.withColumn("__query_norm", norm_of(F.col("__query"))))).withColumn("score", score)
            return pairs.where((F.col("score") > 0) & (F.col("score") >= min_score)).select("query_id", self.id_col, "score")

        return found_in

    def get(self, doc_id: Any) -> DataFrame:
        """The document of that id: one row or none."""
        return self.df.where(F.col(self.id_col) == F.lit(doc_id))

    def count(self) -> int:
        n = self.df.count()
        self._record("documents.count", n)
        return n

    def add(self, docs: DataFrame) -> Collection:
        """Upsert: the given documents replace those of equal id; fields that one side lacks are null there."""
        self._record("insert.count", 1)
        kept = self.df.join(docs.select(self.id_col).distinct(), self.id_col, "left_anti")
        return self._with(unify([kept, docs]))

    def remove(self, ids: DataFrame | Iterable[Any]) -> Collection:
        """Without the documents of the given ids; unknown ids are no error."""
        self._record("remove.count", 1)
        if isinstance(ids, DataFrame):
            return self._with(self.df.join(ids.select(F.col(ids.columns[0]).alias(self.id_col)).distinct(), self.id_col, "left_anti"))
        values = list(ids)
        return self._with(self.df.where(~F.coalesce(F.col(self.id_col).isin(values), F.lit(False)))) if values else self

    def view(self, name: str) -> Collection:
        """Register the collection for SQL."""
        self.df.createOrReplaceTempView(name)
        return self

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.df.unpersist()
