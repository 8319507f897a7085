"""Batch ingestion: suppliers give documents, valid ones are appended, the others are reported."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import kind_of
from .documents import rectangular, unify
from .log import MutationLog

#: A supplier makes a DataFrame of documents when it is called, not before.
Supplier = Callable[[], DataFrame]


@dataclass(frozen=True)
class IngestionResult:
    total: int
    ingested: int
    errors: list[tuple[str | None, str]] = field(default_factory=list)


def problems(df: DataFrame, id_col: str = "doc_id", dimensions: dict[str, int] | None = None) -> Column:
    """The first reason why a document can't be ingested, or null: no id, a ragged matrix, a vector of the wrong length."""
    checks = [F.when(F.col(id_col).isNull(), "no id")]
    for f in df.schema.fields:
        if kind_of(f.dataType) == "matrix":
            checks.append(F.when(~rectangular(F.col(f.name)), f"ragged matrix: {f.name}"))
    for name, n in (dimensions or {}).items():
        checks.append(F.when(F.size(name) != n, f"wrong length: {name}"))
    return F.coalesce(*checks)


def validate(df: DataFrame, id_col: str = "doc_id", dimensions: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good documents, (id, error) of the others)."""
    marked = df.withColumn("__error", problems(df, id_col, dimensions))
    return marked.where("__error is null").drop("__error"), marked.where("__error is not null").select(F.col(id_col).cast("string").alias(id_col), F.col("__error").alias("error"))


def summary(df: DataFrame, id_col: str = "doc_id", dimensions: dict[str, int] | None = None) -> DataFrame:
    """(total, ingested, errors) of what ``validate`` would do, in one pass."""
    bad = problems(df, id_col, dimensions).isNotNull()
    return df.agg(F.count("*").alias("total"), F.count_if(~bad).alias("ingested"), F.count_if(bad).alias("errors"))


def ingest(suppliers: Iterable[Supplier], log: MutationLog, dimensions: dict[str, int] | None = None, report: int = 1000) -> IngestionResult:
    """Append the valid documents of all suppliers as one transaction. At most ``report`` errors are listed; all are counted.

    A supplier that fails is an error of its own and doesn't stop the others.
    """
    parts, failures = [], []
    for supplier in suppliers:
        try:
            parts.append(supplier())
        except Exception as e:  # any failure of a source is reported
            failures.append((None, f"{type(e).__name__}: {e}"))
    if not parts:
        return IngestionResult(len(failures), 0, failures)
    df = unify(parts)
    good, bad = validate(df, log.id_col, dimensions)
    counts = summary(df, log.id_col, dimensions).first()
    if counts["ingested"]:
        log.add(good)
    listed = [(r[0], r[1]) for r in bad.limit(report).collect()] if counts["errors"] else []
    return IngestionResult(counts["total"] + len(failures), counts["ingested"], failures + listed)
