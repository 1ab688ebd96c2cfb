"""Nearest neighbours of a query set by a block matrix join with quantised products.

Queries and candidates are packed into blocks. Each vector of a block is also kept
as int8 codes with its scale and the exact length of its quantisation error. A tile
is the product of the codes of a query block with those of a candidate block; with
the error lengths it bounds every cosine from both sides. A candidate whose upper
bound lies below the k-th best lower bound of a query is done with. The survivors
are computed again in double precision and merged by a heap per query. Bounds are
safe, so the result is that of brute force.

Of equal vectors in a block only k rows besides those of the query's own id can be
among the k nearest, those with the smallest ids. So 2 k rows are kept, of them at most
k of one id, and a vector that a third of the rows share is compared a few times a block.

Defined results: unusable vectors take no part; vectors of another length than the
query are no candidates; every row but those with the query's own id is one; rows
without an id are none; repeated rows of one id can take several ranks. Repeated rows
of a query's id are queries each, and what they find is ranked together, as by a join.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import cut
from spendlens.llm.vectors import matrix, packed_vectors, precision, unit

K = 5
BLOCK = 4096
QUERY_BLOCK = 1024
BLOCKS_PER_TASK = 8


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and lengths of the rounding errors of unit vectors."""
    scale = np.abs(rows).max(axis=1) / 127
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(rows - codes * scale[:, None], axis=1)


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of row pairs, every sum taken in order of the components."""
    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1]

    return np.clip(total(queries * rows) / np.sqrt(total(queries * queries) * total(rows * rows)), -1, 1)


def _block(kind: str, copies: int | None):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        if copies is not None:
            group = group[group.groupby(["node", "vec_id"]).cumcount() < copies]
            group = group[group.groupby("node").cumcount() < 2 * copies]
        codes, scale, error = quantised(unit(matrix(b"".join(group["vector"]), kind, len(group))))
        row = {"width": group["width"].iloc[0], "block": group["block"].iloc[0]}
        row |= {"ids": group["vec_id"].to_numpy(np.int64).tobytes(), "vectors": b"".join(group["vector"])}
        row |= {"codes": codes.tobytes(), "scale": scale.tobytes(), "error": error.tobytes()}
        return pd.DataFrame([row])

    return run


class Side:
    def __init__(self, row: pd.Series, kind: str):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.rows = matrix(row["vectors"], kind, len(self.ids))
        # Products of int8 codes are whole numbers below 2**24, so single precision holds them exactly.
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(len(self.ids), -1).astype(np.float32)
        self.scale, self.error = np.frombuffer(row["scale"], np.float64), np.frombuffer(row["error"], np.float64)


def tile_survivors(q: Side, c: Side, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that may be among the k nearest, given the k-th best score so far."""
    near = (q.codes @ c.codes.T) * np.outer(q.scale, c.scale)
    slack = q.error[:, None] + (1 + q.error[:, None]) * c.error[None, :] + 1e-9
    near[q.ids[:, None] == c.ids[None, :]] = -np.inf
    low = near - slack
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
    return np.nonzero((near + slack >= floor[:, None]) & np.isfinite(near))


def _merged(best: list[list[tuple[float, int]]], q: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    for i, score, vec_id in zip(q.tolist(), scores.tolist(), ids.tolist(), strict=True):
        entry = (score, -vec_id)
        if len(best[i]) < k:
            heapq.heappush(best[i], entry)
        elif entry > best[i][0]:
            heapq.heapreplace(best[i], entry)


def _nearest(kind: str, k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        is_query = group["is_query"].to_numpy(bool)
        rows = []
        for _, query in group[is_query].iterrows():
            q = Side(query, kind)
            best: list[list[tuple[float, int]]] = [[] for _ in q.ids]
            for _, block in group[~is_query].sort_values("block").iterrows():
                c = Side(block, kind)
                floor = np.array([h[0][0] if len(h) == k else -np.inf for h in best])
                x, y = tile_survivors(q, c, floor, k)
                for at in range(0, len(x), 100_000):
                    part = slice(at, at + 100_000)
                    _merged(best, x[part], exact(q.rows[x[part]], c.rows[y[part]]), c.ids[y[part]], k)
            rows += [(int(i), -n, s) for i, heap in zip(q.ids, best, strict=True) for s, n in heap]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k rows nearest to each row that ``is_query`` names.

    A cell of the grid of query blocks and groups of candidate blocks is one group
    of bounded size; its k best per query are ranked with those of the other cells.
    """
    kind = precision(vectors)
    width = F.octet_length("vector").alias("width")
    rows = cut(packed_vectors(vectors).filter("vec_id is not null").select("vec_id", "node", "vector", width))
    asked = rows.filter(is_query)
    parts, asked_parts = -(-max(1, rows.count()) // BLOCK), -(-max(1, asked.count()) // QUERY_BLOCK)
    schema = "width int, block int, ids binary, vectors binary, codes binary, scale binary, error binary"

    def blocks(side: DataFrame, n: int, copies: int | None) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block")
        return cut(side.select("*", block).groupBy("width", "block").applyInPandas(_block(kind, copies), schema))

    groups = -(-parts // BLOCKS_PER_TASK)
    candidates = blocks(rows, parts, k).withColumn("is_query", F.lit(False))
    candidates = candidates.withColumn("g", (F.col("block") / BLOCKS_PER_TASK).cast("int"))
    candidates = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))))
    queries = blocks(asked, asked_parts, None).withColumn("is_query", F.lit(True)).withColumn("q", F.col("block"))
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cells = candidates.unionByName(queries).groupBy("width", "q", "g")
    found = cells.applyInPandas(_nearest(kind, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
