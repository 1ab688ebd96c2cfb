"""Bloom filters in numpy, filled by tasks and merged in pieces."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spendlens.llm.common import merged_chunks

BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 2**19, 2**28
PROBES = 4
CHUNK = 2**16  # bytes of a filter that are merged together


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of 64-bit hashes, one row per probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


class BloomFilter:
    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = probes(hashes, self.bits).ravel()
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = probes(hashes, self.bits)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def filter_bits(rows: int, per_row: int = BITS_PER_ROW) -> int:
    """A power of two that gives each row so many bits, within the bounds."""
    return int(min(MAX_BITS, max(MIN_BITS, 2 ** int(np.ceil(np.log2(max(1, rows * per_row)))))))


def packed_chunks(*filters: BloomFilter) -> Iterator[pd.DataFrame]:
    """Rows ``chunk, f0, f1, ...`` of the pieces in which the first filter has any bit."""
    size = min(CHUNK, filters[0].bits // 8)
    columns = ["chunk", *(f"f{i}" for i in range(len(filters)))]
    for chunk in range(filters[0].bits // 8 // size):
        part = slice(chunk * size, (chunk + 1) * size)
        if filters[0].data[part].any():
            yield pd.DataFrame([[chunk, *(zlib.compress(f.data[part].tobytes(), 1) for f in filters)]], columns=columns)


def merged_filter(parts: DataFrame, bits: int, columns: list[str], merge: Callable, wanted: str) -> BloomFilter:
    """Fold the parts of all tasks; only the wanted filter, of bounded size, comes to the driver."""

    def folded(old: list[bytes], new: list[bytes]) -> list[bytes]:
        old, new = ([np.frombuffer(zlib.decompress(x), np.uint8) for x in y] for y in (old, new))
        return [zlib.compress(x.tobytes(), 1) for x in merge(old, new)]

    size, data = min(CHUNK, bits // 8), bytearray(bits // 8)
    for row in merged_chunks(parts, folded, columns).select("chunk", wanted).collect():
        data[row.chunk * size : (row.chunk + 1) * size] = zlib.decompress(row[wanted])
    return BloomFilter(bits, bytes(data))


def filter_of(hashes: DataFrame, column: str, rows: int) -> BloomFilter:
    """A filter that holds every value of a column of 64-bit hashes."""
    bits = filter_bits(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = BloomFilter(bits)
        for batch in batches:
            own.add(batch[column].to_numpy(np.int64).view(np.uint64))
        yield from packed_chunks(own)

    parts = hashes.select(column).mapInPandas(run, "chunk int, f0 binary")
    return merged_filter(parts, bits, ["f0"], lambda old, new: [old[0] | new[0]], "f0")
