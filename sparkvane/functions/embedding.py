"""Embedding functions: any text-to-vector function as an Arrow UDF, and a deterministic one that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


def hashed_embedding(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of hashed character trigrams, scaled to unit length: for tests and demonstrations."""
    out = np.zeros(dimensions, np.float32)
    padded = f"  {(text or '').lower()} "
    for i in range(len(padded) - 2):
        h = zlib.crc32(padded[i : i + 3].encode())
        out[h % dimensions] += 1 if h & 0x10000 else -1
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def embed(text: Column, function: Callable[[list[str | None]], Sequence[Sequence[float]]] | None = None) -> Column:
    """A vector column. ``function`` maps a list of texts to vectors; it is called once for each Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        texts = batch.tolist()
        vectors = [hashed_embedding(t) for t in texts] if function is None else function(texts)
        return pd.Series([np.asarray(v, dtype=np.float32) for v in vectors])

    return run(text)
