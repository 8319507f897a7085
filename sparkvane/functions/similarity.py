"""Vector similarity as columns: higher-order functions that Catalyst sees through, summed in a fixed order."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def literal_vector(vector: Sequence[float], kind: str = "double") -> Column:
    values = [float(x) for x in vector]
    if not all(map(math.isfinite, values)):
        return F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>")
    return F.expr(f"CAST(array({', '.join(f'{x!r}D' for x in values)}) AS array<{kind}>)")  # one call, whatever the length


def dot(a: Column, b: Column, precision: str = "float64") -> Column:
    """Sum of products from left to right, accumulated in double or, for ``float32``, in single precision."""
    if precision == "float32":
        return F.aggregate(F.zip_with(a.cast("array<float>"), b.cast("array<float>"), lambda x, y: x * y), F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _norm_of(vector: Sequence[float]) -> float:
    total = 0.0
    for x in vector:
        total += x * x
    return math.sqrt(total)


def norm_of(a: Column, precision: str = "float64") -> Column:
    return F.sqrt(dot(a, a, precision).cast("double"))


def cosine(a: Column, vector: Sequence[float] | Column, precision: str = "float64", norm: Column | None = None, query_norm: Column | None = None) -> Column:
    """Cosine similarity; 0 for a zero vector. ``norm`` and ``query_norm`` may be columns of known norms.

    A literal query's norm is worked out once, on the driver.
    """
    if isinstance(vector, Column):
        b, nb = vector, F.sqrt(dot(vector, vector, precision).cast("double")) if query_norm is None else query_norm
    elif precision == "float32":
        b = literal_vector(vector, "float")
        nb = F.sqrt(dot(b, b, precision).cast("double"))
    else:
        b, nb = literal_vector(vector), F.lit(_norm_of(vector))
    na = norm_of(a, precision) if norm is None else norm
    below = F.greatest(na * nb, F.lit(EPSILON))
    if precision == "float32":
        return (dot(a, b, precision) / below.cast("float")).cast("float")
    return dot(a, b, precision) / below


def dot_product(a: Column, vector: Sequence[float] | Column, precision: str = "float64", norm: Column | None = None, query_norm: Column | None = None) -> Column:
    return dot(a, vector if isinstance(vector, Column) else literal_vector(vector), precision)


def l2_closeness(a: Column, vector: Sequence[float] | Column, precision: str = "float64", norm: Column | None = None, query_norm: Column | None = None) -> Column:
    """1 / (1 + Euclidean distance): greater is closer, as for the other measures."""
    b = vector if isinstance(vector, Column) else literal_vector(vector)
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(square))


#: Measures by name; others can be added. Each takes (column, vector or column, precision, norm columns).
METRICS: dict[str, Callable[..., Column]] = {"cosine": cosine, "dot": dot_product, "l2": l2_closeness}


def checked(a: Column, length: int, value: Column, on_mismatch: str) -> Column:
    """``value``, or for a vector of another length an error (``error``) or null (``skip``)."""
    if on_mismatch == "skip":
        return F.when(F.size(a) == length, value)
    wrong = F.raise_error(F.concat(F.lit(f"vectors differ in length: {length} and "), F.size(a).cast("string")))
    return F.when(a.isNull(), F.lit(None)).when(F.size(a) != length, wrong).otherwise(value)


def matrix_similarity(m: Column, one: Callable[[Column], Column]) -> Column:
    """Mean of the rows' similarities; null for a matrix without rows."""
    total = F.aggregate(F.transform(m, lambda row: one(row).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(m) > 0, total / F.size(m))


def rounded_score(score: Column) -> Column:
    """Two decimals, halves towards positive infinity."""
    return F.floor(100 * score + 0.5) / 100
