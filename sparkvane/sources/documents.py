"""Documents of differing shapes in one DataFrame; ids from names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import kind_of



def unify(parts: list[DataFrame]) -> DataFrame:
    """The union by name; a column that a part lacks is null there.

    A name that has values of different kinds becomes one column for each kind: the first keeps its name, another is called
    ``name__kind``.
    """
    first: dict[str, str | None] = {}
    for p in parts:
        for f in p.schema.fields:
            first.setdefault(f.name, kind_of(f.dataType) or f.dataType.typeName())
    named = []
    for p in parts:
        renamed = {f.name: f"{f.name}__{k}" for f in p.schema.fields if (k := kind_of(f.dataType) or f.dataType.typeName()) != first[f.name]}
        named.append(p.withColumnsRenamed(renamed))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def coerce(df: DataFrame) -> DataFrame:
    """Columns of the document model's types: 32-bit or longer integers, vectors and matrices stay, all other scalars become text."""
    out = []
    for f in df.schema.fields:
        kind = kind_of(f.dataType)
        out.append(F.col(f"`{f.name}`") if kind else F.col(f"`{f.name}`").cast("string").alias(f.name))
    return df.select(*out)


def name_uuid(name: Column) -> Column:
    """The name-based (version 3) UUID of a string's UTF-8 bytes: equal names give equal ids."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def random_ids(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Random ids where there is none. They differ from run to run: write the result before using it twice."""
    known = F.col(id_col) if id_col in df.columns else F.lit(None).cast("string")
    return df.withColumn(id_col, F.coalesce(known, F.uuid()))


def rectangular(matrix: Column) -> Column:
    """Whether all rows of a matrix have one length; true for null and for no rows."""
    return F.coalesce(F.size(F.array_distinct(F.transform(matrix, F.size))) <= 1, F.lit(True))
