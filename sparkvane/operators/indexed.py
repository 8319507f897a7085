"""A collection with indexes: the indexed part of a query narrows the documents, the whole query then filters and scores them.

So an indexed search returns what a scan returns, whatever the tree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame

from ..plans.query import Multi, Not, Query, QueryBuilder, Similar, StringMatch
from .collection import Collection
from .string_index import StringIndex, term_test
from .vector_index import VectorIndex


def _folded(op: str, a: tuple[str, Column, bool], b: tuple[str, Column, bool]) -> tuple[str, Column, bool]:
    return (a[0], a[1] & b[1], a[2] and b[2]) if op == "AND" else (a[0], a[1] | b[1], a[2] or b[2])


class IndexedCollection(Collection):
    def __init__(self, df: DataFrame, id_col: str = "doc_id", **options: Any) -> None:
        super().__init__(df, id_col, **options)
        self.string_indexes: dict[str, StringIndex] = {}
        self.vector_indexes: dict[str, VectorIndex] = {}

    @classmethod
    def configured(cls, df: DataFrame, config: Mapping[str, str], id_col: str = "doc_id") -> IndexedCollection:
        """From a flat configuration: ``string_indexes`` and ``vector_indexes`` are comma-separated fields, ``nlist`` a number."""
        out = cls(df, id_col)
        fields = lambda key: [f.strip() for f in config.get(key, "").split(",") if f.strip()]
        for f in fields("string_indexes"):
            out.with_string_index(f)
        for f in fields("vector_indexes"):
            out.with_vector_index(f, nlist=int(config["nlist"]) if "nlist" in config else None)
        return out

    def with_string_index(self, field: str, path: str | None = None) -> IndexedCollection:
        index = StringIndex.build(self.df, field, self.id_col)
        self.string_indexes[field] = index.write(path) if path else index
        return self

    def with_vector_index(self, field: str, nlist: int | None = None, path: str | None = None) -> IndexedCollection:
        index = VectorIndex.build(self.df, field, self.id_col, nlist)
        self.vector_indexes[field] = index.write(path) if path else index
        return self

    def is_indexed(self, field: str, kind: str = "string") -> bool:
        return field in (self.string_indexes if kind == "string" else self.vector_indexes)

    def _term_test(self, query: Query) -> tuple[str, Column, bool] | None:
        """A tree on one indexed field as (field, condition on the term, whether documents without the field match); None for any other tree."""
        if isinstance(query, StringMatch) and query.field in self.string_indexes:
            return query.field, term_test(query), False
        if isinstance(query, Not):
            child = self._term_test(query.child)
            return (child[0], ~child[1], not child[2]) if child else None
        if isinstance(query, Multi):
            parts = [self._term_test(q) for q in query.operands]
            if parts and all(p is not None and p[0] == parts[0][0] for p in parts):
                return reduce(partial(_folded, query.op), parts)
        return None

    def _ids_of(self, field: str, test: Column, missing: bool) -> DataFrame:
        index = self.string_indexes[field]
        return self._all_but(index.matching(~test)) if missing else index.matching(test)

    def _all_but(self, ids: DataFrame) -> DataFrame:
        return self.df.select(self.id_col).join(ids.hint("merge"), self.id_col, "left_anti")

    def candidate_ids(self, query: Query) -> tuple[DataFrame, bool] | None:
        """Ids of a superset of the matches from the string indexes, and whether they are the matches exactly; None if no index helps.

        What a tree asks of one field is one condition on its terms, so it takes one pass over that index. AND takes what its operands give, OR
        needs all of them, NOT needs an exact child. Ids may be repeated. Sets are joined by merging, as in ``idsets``.
        """
        one = self._term_test(query)
        if one:
            return self._ids_of(*one), True
        if isinstance(query, Not):
            child = self.candidate_ids(query.child)
            return (self._all_but(child[0]), True) if child and child[1] else None
        if isinstance(query, Multi):
            tests: dict[str, tuple[str, Column, bool]] = {}
            parts = []
            for q in query.operands:
                one = self._term_test(q)
                if one:
                    tests[one[0]] = _folded(query.op, tests[one[0]], one) if one[0] in tests else one
                else:
                    parts.append(self.candidate_ids(q))
            parts = [*((self._ids_of(*t), True) for t in tests.values()), *parts]
            known = [p for p in parts if p is not None]
            if not known or (query.op == "OR" and len(known) < len(parts)):
                return None
            out = known[0][0]
            for p in known[1:]:
                out = out.join(p[0].hint("merge"), self.id_col, "left_semi") if query.op == "AND" else out.union(p[0])
            return out, len(known) == len(parts) and all(p[1] for p in known)
        return None

    def search_indexed(self, query: Query | QueryBuilder, k: int | None = None, **options: Any) -> DataFrame:
        """The same rows as ``search``, read through the string indexes."""
        query = query.build() if isinstance(query, QueryBuilder) else query
        found = self.candidate_ids(query)
        if found is None:
            return self.search(query, k, **options)
        narrowed = self.df.join(found[0].hint("merge"), self.id_col, "left_semi").select(*self.df.columns)
        return self._with(narrowed).search(query, k, **options)

    def search_nearest(self, field: str, vector: Sequence[float], k: int, nprobe: int | None = None, query: Query | None = None, blend_match_all: bool = False) -> DataFrame:
        """Approximate nearest documents; with ``query``, among its matches, which are found exactly."""
        if field not in self.vector_indexes:
            return self.search(Similar(field, tuple(vector)), k)
        index = self.vector_indexes[field]
        if query is not None:
            matches = self.scored(query).select(self.id_col)
            index = VectorIndex(index.lists.join(matches, self.id_col, "left_semi"), index.centroids, field, self.id_col)  # without ``nprobe`` all lists
        return index.search(vector, k, nprobe, blend_match_all=blend_match_all)
