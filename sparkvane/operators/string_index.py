"""An inverted index on a string field. The whole value is the term.

Postings are flat (term, id) rows, range-partitioned and sorted by term, so that a frequent term needs no huge array and the
files' minima and maxima prune equality and prefix lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import StringMatch
from .idsets import ids

#: Ids found that are broadcast to the documents; more are joined by shuffle. Counted, as estimates from compressed files are far too low.
BROADCAST_IDS = 100_000


def term_test(query: StringMatch) -> Column:
    """The predicate on the column ``term``."""
    term, v = F.col("term"), F.lit(query.value)
    return {"equals": term == v, "starts_with": term.startswith(v), "ends_with": term.endswith(v), "contains": term.contains(v)}[query.op]


class StringIndex:
    def __init__(self, postings: DataFrame, field: str, id_col: str) -> None:
        self.postings, self.field, self.id_col = postings, field, id_col

    @classmethod
    def build(cls, df: DataFrame, field: str, id_col: str = "doc_id") -> StringIndex:
        """Postings of every document that has the field. A repeated document has repeated ones until the index is written, which no search shows."""
        return cls(df.where(F.col(field).isNotNull()).select(F.col(field).alias("term"), id_col), field, id_col)

    def write(self, path: str) -> StringIndex:
        self.postings.distinct().repartitionByRange("term").sortWithinPartitions("term", self.id_col).write.parquet(path)
        return StringIndex(self.postings.sparkSession.read.parquet(path), self.field, self.id_col)

    @classmethod
    def read(cls, spark: SparkSession, path: str, field: str, id_col: str = "doc_id") -> StringIndex:
        return cls(spark.read.parquet(path), field, id_col)

    def matching(self, test: Column) -> DataFrame:
        """Ids of the postings for which a condition on ``term`` holds, as they come: for semi and anti joins, which need no distinct ones."""
        return self.postings.where(test).select(self.id_col)

    def lookup(self, query: StringMatch) -> DataFrame:
        """Ids of the documents whose value satisfies the predicate."""
        return ids(self._found(query), self.id_col)

    def _found(self, query: StringMatch) -> DataFrame:
        if query.field != self.field:
            raise ValueError(f"the index is on {self.field!r}")
        return self.matching(term_test(query))

    def search(self, df: DataFrame, query: StringMatch) -> DataFrame:
        """The documents of ``df`` that the index finds; documents removed since are not returned."""
        found = self._found(query)
        return df.join(found.hint("broadcast" if found.count() <= BROADCAST_IDS else "merge"), self.id_col, "left_semi")
