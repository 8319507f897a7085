"""Algebra of document id sets: each set is a DataFrame with one id column.

Sets are joined by merging: a task holds its partition's ids, never a whole set, however small the planner takes it to be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col).distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.hint("merge"), a.columns[0], "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.hint("merge"), a.columns[0], "left_anti")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return either(a, b)


def contains(a: DataFrame, value: object) -> bool:
    return not a.where(a[a.columns[0]] == value).isEmpty()


def cardinality(a: DataFrame) -> int:
    return a.distinct().count()
