"""Helpers for tables of vectors (vec_id, embedding)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


#: A vector that isn't null, empty or zero and holds only finite numbers.
USABLE = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"


def key(column: str = "embedding"):
    """A hash of the vector's numbers."""
    return F.sha2(F.to_json(F.transform(column, lambda x: x + F.lit(0).cast("float"))).cast("binary"), 256)


def matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, width or 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; very large or small rows are scaled by their largest part first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
