"""Reading and packing embedding vectors for block-wise work."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import by_batch


def usable(embedding: Column) -> Column:
    """Vectors without NULL or non-finite components that are not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _named(kind: str):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        packed = [(np.asarray(v, kind) + 0.0).tobytes() for v in batch["embedding"]]  # -0.0 becomes 0.0
        node = [int.from_bytes(blake2b(p, digest_size=8).digest(), "little", signed=True) for p in packed]
        return pd.DataFrame({"vec_id": batch["vec_id"], "node": node, "vector": packed})

    return by_batch(run)


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, node, vector`` of the usable rows: bytes in the table's own precision, and a hash that names equal ones."""
    # Ids go through as text, since pandas would turn those beside a NULL into doubles.
    rows = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding").filter(usable(F.col("embedding")))
    named = rows.mapInPandas(_named(precision(vectors)), "vec_id string, node long, vector binary")
    return named.withColumn("vec_id", F.col("vec_id").cast("long"))


def precision(vectors: DataFrame) -> str:
    """Kind of number in the packed bytes."""
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def matrix(packed: bytes, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(packed, kind).reshape(rows, -1).astype(np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither tiny nor huge components are lost in the squares.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
