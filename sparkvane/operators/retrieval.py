"""Retrieval for prompts: relevant files and context of the best passages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import rounded_score
from ..plans.query import Similar
from .collection import Collection

TEMPLATE = "Answer with the help of these passages.\n\n{context}\n\nQuestion: {question}"


def relevant_files(files: DataFrame, vector: Sequence[float], min_score: float = 0.5, field: str = "embedding", id_col: str = "name") -> DataFrame:
    """All files of at least ``min_score``, best first, with the score to two decimals. There is no limit."""
    hits = Collection(files, id_col).search(Similar(field, tuple(vector)), min_score=min_score)
    return hits.withColumn("score", rounded_score(F.col("score"))).drop(field)


def context(passages: DataFrame, vector: Sequence[float], k: int = 2, min_score: float = 0.85, field: str = "embedding", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(n_passages, context): the distinct texts of the best ``k`` passages, joined by blank lines in order of score."""
    top = Collection(passages, id_col).search(Similar(field, tuple(vector)), k, min_score=min_score)
    one = top.groupBy(text).agg(F.max("score").alias("score"), F.min(id_col).alias("id"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", F.col(text).alias("t"))))
    return one.agg(F.count("*").alias("n_passages"), F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("context"))


def prompt(passages: DataFrame, question: str, vector: Sequence[float], template: str = TEMPLATE, **options: object) -> str:
    """The question with its context; the bare question if nothing is relevant."""
    row = context(passages, vector, **options).first()
    return template.format(context=row["context"], question=question) if row["n_passages"] else question
