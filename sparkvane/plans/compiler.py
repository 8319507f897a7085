"""Compiles a query tree to columns: a necessary condition that scans can use, a match and a score.

Two scoring profiles exist.

``mean``: a Boolean leaf scores 1 or 0, a vector leaf its similarity; AND is 0 if an operand is exactly 0 and the mean otherwise, OR the mean,
NOT 1 for exactly 0 and else 0. A document is a hit if its score is positive.

``geometric``: a vector leaf matches if its similarity is positive; AND folds to sqrt(a b), OR to (a + b) / 2 where they match and 0
elsewhere, NOT to 1 - s. A document is a hit if it matches.

Predicates are two-valued: a missing field, or one of another type, fails its predicate, and NOT of that holds. Only what
sits under a NOT is coalesced, so that plain comparisons still reach the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import METRICS, checked, matrix_similarity
from .query import IntCompare, MatchAll, MatchNone, Multi, Not, Query, Similar, StringMatch

_STRING: dict[str, Callable[[Column, str], Column]] = {
    "equals": lambda c, v: c == F.lit(v),
    "starts_with": lambda c, v: c.startswith(F.lit(v)),
    "ends_with": lambda c, v: c.endswith(F.lit(v)),
    "contains": lambda c, v: c.contains(F.lit(v)),
}
_INTEGER: dict[str, Callable[[Column, int], Column]] = {
    "=": lambda c, v: c == F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
}


def kind_of(data_type: T.DataType) -> str | None:
    """The kind of a field: string, integer, vector or matrix; None for any other type."""
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(data_type, T.ArrayType):
        if isinstance(data_type.elementType, (T.FloatType, T.DoubleType)):
            return "vector"
        if isinstance(data_type.elementType, T.ArrayType) and kind_of(data_type.elementType) == "vector":
            return "matrix"
    return None


@dataclass
class Compiled:
    """``necessary`` goes into a filter of its own before the score is computed; ``hit`` decides.

    ``exact``: the necessary condition is the hit itself, as for trees without vectors, so no filter on the score is needed.
    """

    necessary: Column | None
    score: Column
    hit: Column
    exact: bool


@dataclass
class _Node:
    boolean: Column | None  # the predicate, for trees of Boolean leaves only
    necessary: Column | None  # None: always true
    match: Column
    score: Column


class Compiler:
    def __init__(self, schema: T.StructType, scoring: str = "mean", precision: str = "float64", metric: str = "cosine", on_mismatch: str = "error", norms: dict[str, str] | None = None) -> None:
        if scoring not in ("mean", "geometric"):
            raise ValueError(f"unknown scoring {scoring!r}")
        self.kinds = {f.name: kind_of(f.dataType) for f in schema.fields}
        self.scoring, self.precision, self.metric, self.on_mismatch = scoring, precision, METRICS[metric], on_mismatch
        self.norms = norms or {}

    def compile(self, query: Query) -> Compiled:
        node = self._node(query, False)
        if self.scoring == "mean":
            return Compiled(node.necessary, node.score, F.coalesce(node.score > 0, F.lit(False)), node.boolean is not None)
        return Compiled(node.necessary, node.score, node.match, node.boolean is not None)

    def _node(self, q: Query, negated: bool) -> _Node:
        if isinstance(q, (MatchAll, MatchNone)):
            return self._boolean(F.lit(isinstance(q, MatchAll)))
        if isinstance(q, StringMatch):
            found = self.kinds.get(q.field) == "string"
            return self._leaf(_STRING[q.op](F.col(f"`{q.field}`"), q.value) if found else F.lit(False), negated)
        if isinstance(q, IntCompare):
            found = self.kinds.get(q.field) == "integer"
            return self._leaf(_INTEGER[q.op](F.col(f"`{q.field}`"), q.value) if found else F.lit(False), negated)
        if isinstance(q, Similar):
            return self._vector(q)
        if isinstance(q, Not):
            return self._not(self._node(q.child, True))
        if isinstance(q, Multi):
            return self._multi(q.op, [self._node(x, negated) for x in q.operands])
        raise TypeError(f"not a query: {q!r}")

    def _boolean(self, p: Column) -> _Node:
        return _Node(p, p, p, F.when(p, 1.0).otherwise(0.0))

    def _leaf(self, p: Column, negated: bool) -> _Node:
        return self._boolean(F.coalesce(p, F.lit(False)) if negated else p)

    def _vector(self, q: Similar) -> _Node:
        kind, column = self.kinds.get(q.field), F.col(f"`{q.field}`")
        if kind not in ("vector", "matrix"):
            return _Node(None, None, F.lit(False), F.lit(0.0))

        def one(v: Column) -> Column:
            norm = F.col(f"`{self.norms[q.field]}`") if kind == "vector" and q.field in self.norms else None
            return checked(v, len(q.vector), self.metric(v, q.vector, self.precision, norm), self.on_mismatch)

        value = (one(column) if kind == "vector" else matrix_similarity(column, one)).cast("double")
        s = F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
        return _Node(None, None, s > 0, s)

    def _not(self, c: _Node) -> _Node:
        p = None if c.boolean is None else ~c.boolean
        if self.scoring == "mean":
            score = F.when(c.score == 0, 1.0).otherwise(0.0)
            return _Node(p, p, score > 0, score)
        return _Node(p, p, ~c.match, 1 - c.score)

    def _multi(self, op: str, nodes: list[_Node]) -> _Node:
        both = (lambda a, b: a & b) if op == "AND" else (lambda a, b: a | b)
        boolean = None if any(n.boolean is None for n in nodes) else reduce(both, [n.boolean for n in nodes])
        conditions = [n.necessary for n in nodes]
        if op == "AND":
            known = [c for c in conditions if c is not None]
            necessary = reduce(both, known) if known else None
        else:
            necessary = None if any(c is None for c in conditions) else reduce(both, conditions)
        if self.scoring == "mean":
            mean = reduce(lambda a, b: a + b, [n.score for n in nodes]) / float(len(nodes))
            score = mean if op == "OR" else F.when(reduce(lambda a, b: a | b, [n.score == 0 for n in nodes]), 0.0).otherwise(mean)
            return _Node(boolean, necessary, score > 0, score)
        match, score = nodes[0].match, nodes[0].score
        for n in nodes[1:]:
            match = both(match, n.match)
            folded = F.sqrt(F.greatest(score * n.score, F.lit(0.0))) if op == "AND" else (score + n.score) / 2.0
            score = F.when(match, folded).otherwise(0.0)
        return _Node(boolean, necessary, match, score)
