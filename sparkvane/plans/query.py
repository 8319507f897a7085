"""Boolean query trees over document fields, and a fluent builder for them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

STRING_OPS = ("equals", "starts_with", "ends_with", "contains")
INTEGER_OPS = ("=", "<", "<=", ">", ">=")


class Query:
    """A node of a query tree."""


@dataclass(frozen=True)
class StringMatch(Query):
    """A case-sensitive comparison of a string field with literal text."""

    field: str
    op: str
    value: str

    def __post_init__(self) -> None:
        if self.op not in STRING_OPS:
            raise ValueError(f"unknown string operator {self.op!r}")
        if not isinstance(self.value, str):
            raise ValueError("a string predicate needs a string")


@dataclass(frozen=True)
class IntCompare(Query):
    """A comparison of an integer field with a number."""

    field: str
    op: str
    value: int

    def __post_init__(self) -> None:
        if self.op not in INTEGER_OPS:
            raise ValueError(f"unknown integer operator {self.op!r}")
        if isinstance(self.value, bool) or not isinstance(self.value, int):
            raise ValueError("an integer predicate needs an integer")


@dataclass(frozen=True)
class Similar(Query):
    """Similarity of a vector field to a vector; for a matrix field the mean over its rows."""

    field: str
    vector: tuple[float, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "vector", tuple(float(x) for x in self.vector))


@dataclass(frozen=True)
class Multi(Query):
    """AND or OR of two or more operands, in the order given."""

    op: str
    operands: tuple[Query, ...]

    def __post_init__(self) -> None:
        if self.op not in ("AND", "OR"):
            raise ValueError(f"unknown operator {self.op!r}")
        object.__setattr__(self, "operands", tuple(self.operands))
        if len(self.operands) < 2:
            raise ValueError("AND and OR need at least two operands")


@dataclass(frozen=True)
class Not(Query):
    child: Query


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class MatchNone(Query):
    pass


class QueryBuilder:
    """Collects clauses; ``build`` joins them with AND, or with the operator chosen."""

    def __init__(self) -> None:
        self._clauses: list[Query] = []
        self._operator = "AND"

    def _add(self, clause: Query) -> QueryBuilder:
        self._clauses.append(clause)
        return self

    def is_similar_to(self, vector: Sequence[float], field: str) -> QueryBuilder:
        return self._add(Similar(field, tuple(vector)))

    def _similar_all(self, op: str, vector: Sequence[float], fields: Sequence[str]) -> QueryBuilder:
        leaves = tuple(Similar(f, tuple(vector)) for f in fields)
        return self._add(leaves[0] if len(leaves) == 1 else Multi(op, leaves))

    def all_similar_to(self, vector: Sequence[float], fields: Sequence[str]) -> QueryBuilder:
        return self._similar_all("AND", vector, fields)

    def any_similar_to(self, vector: Sequence[float], fields: Sequence[str]) -> QueryBuilder:
        return self._similar_all("OR", vector, fields)

    def is_equal(self, value: str | int, field: str) -> QueryBuilder:
        return self._add(StringMatch(field, "equals", value) if isinstance(value, str) else IntCompare(field, "=", value))

    def starts_with(self, value: str, field: str) -> QueryBuilder:
        return self._add(StringMatch(field, "starts_with", value))

    def ends_with(self, value: str, field: str) -> QueryBuilder:
        return self._add(StringMatch(field, "ends_with", value))

    def contains(self, value: str, field: str) -> QueryBuilder:
        return self._add(StringMatch(field, "contains", value))

    def is_less_than(self, value: int, field: str) -> QueryBuilder:
        return self._add(IntCompare(field, "<", value))

    def is_less_than_or_equal(self, value: int, field: str) -> QueryBuilder:
        return self._add(IntCompare(field, "<=", value))

    def is_greater_than(self, value: int, field: str) -> QueryBuilder:
        return self._add(IntCompare(field, ">", value))

    def is_greater_than_or_equal(self, value: int, field: str) -> QueryBuilder:
        return self._add(IntCompare(field, ">=", value))

    def not_(self, inner: QueryBuilder | Query) -> QueryBuilder:
        return self._add(Not(inner.build() if isinstance(inner, QueryBuilder) else inner))

    def with_operator(self, op: str) -> QueryBuilder:
        if op not in ("AND", "OR"):
            raise ValueError(f"unknown operator {op!r}")
        self._operator = op
        return self

    def build(self) -> Query:
        if not self._clauses:
            raise ValueError("an empty query can't be built")
        return self._clauses[0] if len(self._clauses) == 1 else Multi(self._operator, tuple(self._clauses))
