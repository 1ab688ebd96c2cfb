"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from spendlens.plans.store import new_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and go on from the files, so that nothing upstream runs twice."""
    return written(df, new_folder(df.sparkSession))


def by_batch(function: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """``mapInPandas`` function that treats each batch alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield function(batch)

    return run


def merged_chunks(parts: DataFrame, merge: Callable, columns: list[str]) -> DataFrame:
    """Fold the rows of each ``chunk`` with ``merge(old, new)``, two tuples of bytes.

    The rows come sorted by chunk, so a task holds one folded value at a time
    however many tasks have sent a part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, value = None, None
        for batch in batches:
            for chunk, *new in batch[["chunk", *columns]].itertuples(index=False):
                if chunk == at:
                    value = merge(value, new)
                else:
                    if at is not None:
                        yield pd.DataFrame([[at, *value]], columns=["chunk", *columns])
                    at, value = chunk, new
        if at is not None:
            yield pd.DataFrame([[at, *value]], columns=["chunk", *columns])

    schema = ", ".join(["chunk int", *(f"{c} binary" for c in columns)])
    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(run, schema)


def stacked(column: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of a binary column one after the other, and where each begins."""
    lengths = column.map(len).to_numpy(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column), kind), np.concatenate([[0], np.cumsum(lengths)])
