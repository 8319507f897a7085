"""An embedding store over a collection: external ids, text segments with typed metadata, similarity search."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import Similar
from .collection import Collection

SCHEMA = "doc_id string, extId string, embedding array<float>, text string, metadata map<string, string>"
_TAGS: list[tuple[type, str]] = [(bool, "boolean"), (int, "integer"), (float, "double"), (uuid.UUID, "uuid"), (str, "string")]


def encode(value: Any) -> str:
    """A metadata value as ``type:value``; longs are told from integers by their size."""
    for kind, tag in _TAGS:
        if isinstance(value, kind):
            if tag == "integer" and not -(1 << 31) <= value < 1 << 31:
                tag = "long"
            return f"{tag}:{str(value).lower() if kind is bool else value}"
    raise TypeError(f"unsupported metadata type {type(value).__name__}")


def decode(text: str | None) -> Any:
    """The value of an encoded text. Whatever has no known tag is returned as it is; a value may itself contain colons."""
    if text is None or ":" not in text:
        return text
    tag, _, value = text.partition(":")
    read = {"integer": int, "long": int, "float": float, "double": float, "uuid": uuid.UUID, "string": str, "boolean": lambda v: v == "true"}
    return read[tag](value) if tag in read else text


def decoded(encoded: Column) -> Column:
    """(kind, text, number) of an encoded column; the number is null for kinds that have none."""
    tag = F.regexp_extract(encoded, r"^(integer|long|float|double|uuid|string|boolean):", 1)
    value = F.when(tag != "", F.substring(encoded, F.length(tag) + 2, F.length(encoded))).otherwise(encoded)
    number = F.when(tag.isin("integer", "long", "float", "double"), F.try_to_number(value, F.lit("S999999999999D999999")).cast("double"))
    return F.struct(F.when(tag != "", tag).otherwise("raw").alias("kind"), value.alias("text"), F.coalesce(number, F.when(tag.isin("integer", "long", "float", "double"), value.try_cast("double"))).alias("number"))


class EmbeddingStore:
    """Rows are (doc_id, extId, embedding, text, metadata). Document ids are random; ``extId`` is the caller's, or the document's own."""

    def __init__(self, spark: SparkSession, df: DataFrame | None = None) -> None:
        self.spark = spark
        self.df = df if df is not None else spark.createDataFrame([], SCHEMA)

    def add(self, embedding: Sequence[float], text: str | None = None, ext_id: str | None = None, metadata: dict[str, Any] | None = None) -> str:
        return self.add_all([embedding], [text], [ext_id] if ext_id is not None else None, [metadata])[0]

    def add_all(self, embeddings: Sequence[Sequence[float]], texts: Sequence[str | None] | None = None, ext_ids: Sequence[str] | None = None, metadata: Sequence[dict[str, Any] | None] | None = None) -> list[str]:
        """Append embeddings; the other sequences, where given, must be as long. Existing external ids are not replaced."""
        for other in (texts, ext_ids, metadata):
            if other is not None and len(other) != len(embeddings):
                raise ValueError(f"{len(embeddings)} embeddings, but {len(other)} values for them")
        rows, out = [], []
        for i, e in enumerate(embeddings):
            doc_id = str(uuid.uuid4())
            ext = ext_ids[i] if ext_ids is not None else doc_id
            meta = metadata[i] if metadata is not None else None
            rows.append((doc_id, ext, [float(x) for x in e], texts[i] if texts is not None else None, {k: encode(v) for k, v in (meta or {}).items()}))
            out.append(ext)
        if rows:
            self.df = self.df.unionByName(self.spark.createDataFrame(rows, SCHEMA))
        return out

    def add_frame(self, df: DataFrame) -> None:
        """Append a DataFrame with ``embedding`` and any of extId, text and metadata (an encoded map): the way for large data."""
        has = set(df.columns)
        ids = df.withColumn("doc_id", F.col("doc_id") if "doc_id" in has else F.uuid())
        kinds: T.StructType = self.df.schema
        other = {c: F.col(c) if c in has else F.lit(None).cast(kinds[c].dataType) for c in ("text", "metadata")}
        ids = ids.withColumns({"extId": F.coalesce(F.col("extId"), F.col("doc_id")) if "extId" in has else F.col("doc_id"), **other})
        self.df = self.df.unionByName(ids.select(*self.df.columns))

    def remove(self, ext_id: str) -> None:
        """Remove every row of that external id."""
        self.remove_all([ext_id])

    def remove_all(self, ext_ids: Sequence[str] | None = None) -> None:
        if ext_ids is None:
            self.df = self.spark.createDataFrame([], self.df.schema)
        elif ext_ids:
            self.df = self.df.where(~F.coalesce(F.col("extId").isin(list(ext_ids)), F.lit(False)))

    def search(self, vector: Sequence[float], max_results: int, min_score: float = 0.0, where: Column | None = None) -> DataFrame:
        """(extId, score, embedding, text, metadata) of the best rows of at least ``min_score``; the filter applies before the ranking."""
        df = self.df if where is None else self.df.where(where)
        hits = Collection(df, "doc_id").search(Similar("embedding", tuple(vector)), max_results, min_score=min_score)
        return hits.select("extId", "score", "embedding", "text", "metadata")
