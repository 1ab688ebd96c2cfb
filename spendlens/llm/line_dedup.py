"""Line dedup across documents with two Bloom filters.

The first filter takes every line seen, the second every line seen again. Each
task fills a pair of its own; pairs are merged piece by piece, where a bit that two
first filters share also goes into the second, so the merged second filter holds
every repeated line and a few others. Only lines found in it are shuffled, by a
128-bit digest, to learn exactly which repeat and which document holds the first.

The filters have ``BITS_PER_ROW`` bits a document within the bounds of
``spendlens.llm.bloom``. Beyond some ten million documents they fill up: more lines become
suspects and are shuffled, the result stays the same.

Defined results: a NULL text is one empty line; rows that share a ``doc_id`` are
one document here; rows without a ``doc_id`` count as one document after all
others; lines repeated within one document only are kept; other columns of the
input are passed on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.bloom import BloomFilter, filter_bits, merged_filter, packed_chunks
from spendlens.llm.common import by_batch, cut

MIN_KEY = 10
BLANKS = " \t\n\x0b\x0c\r"
BITS_PER_ROW = 256
LAST_ID = 2**63 - 1


def line_digests(text: str | None, min_key: int = MIN_KEY) -> list[bytes | None]:
    """For each line of a text the digest of its key, None where the key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANKS)
        # Lower-casing bytes changes A to Z only.
        out.append(blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= min_key else None)
    return out


def _hash64(digests: set[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


def _both_filters(bits: int, min_key: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = BloomFilter(bits), BloomFilter(bits)
        for batch in batches:
            if not len(batch):
                continue
            seen = [_hash64(set(line_digests(t, min_key)) - {None}) for t in batch["text"]]
            hashes, counts = np.unique(np.concatenate(seen), return_counts=True)
            again.add(hashes[(counts > 1) | once.has(hashes)])
            once.add(hashes)
        yield from packed_chunks(once, again)

    return run


def _merge(old: list[np.ndarray], new: list[np.ndarray]) -> list[np.ndarray]:
    return [old[0] | new[0], old[1] | new[1] | (old[0] & new[0])]


def seen_again(docs: DataFrame, bits: int, min_key: int = MIN_KEY) -> BloomFilter:
    """The merged second filter: every line that two rows hold is in it."""
    parts = docs.select("text").mapInPandas(_both_filters(bits, min_key), "chunk int, f0 binary, f1 binary")
    return merged_filter(parts, bits, ["f0", "f1"], _merge, "f1")


def _suspects(shared, bits: int, min_key: int):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        again = BloomFilter(bits, shared.value)
        keys, ids, texts = [], [], []
        for doc, name, text in zip(batch["_id"], batch["_text"], batch["text"], strict=True):
            own = list(set(line_digests(text, min_key)) - {None})
            if own:
                found = [d for d, hit in zip(own, again.has(_hash64(own)), strict=True) if hit]
                keys += found
                ids += [doc] * len(found)
                texts += [name] * len(found)
        return pd.DataFrame({"key": keys, "_id": np.array(ids, np.int64), "_text": np.array(texts, np.int64)})

    return by_batch(run)


def _without(min_key: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def run(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for text, keys in zip(texts, gone, strict=True):
            parts = (text or "").split("\n")
            kept = parts
            if keys is not None and len(keys):
                keys = {bytes(k) for k in keys}
                kept = [p for p, d in zip(parts, line_digests(text, min_key), strict=True) if d not in keys]
            rows.append(("\n".join(kept), len(parts), len(parts) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    return run


def _document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def repeated_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """For each document and text that must lose lines, the digests of their keys.

    The hash of the text tells rows of one id, and those without one, apart, so no set is gathered
    over them. Texts that share a hash share the keys of both, and all of these go from either.
    """
    docs = docs.select(_document().alias("_id"), F.xxhash64("text").alias("_text"), "text")
    bits = filter_bits(docs.count(), BITS_PER_ROW)
    shared = docs.sparkSession.sparkContext.broadcast(bytes(seen_again(docs, bits, min_key).data))
    suspects = cut(docs.mapInPandas(_suspects(shared, bits, min_key), "key binary, _id long, _text long"))
    # Both sides are files, so a key with very many documents is split by adaptive execution.
    first = F.min("_id").alias("_first")
    repeats = cut(suspects.groupBy("key").agg(first, F.max("_id").alias("_last")).filter("_first < _last"))
    losing = suspects.join(repeats.select("key", "_first"), "key").filter("_id > _first")
    return losing.groupBy("_id", "_text").agg(F.collect_set("key").alias("_gone"))


def without_repeated_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """Each row of ``docs`` as ``row``, with the ``text`` that is left, ``n_lines`` before and ``n_dropped``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), _document().alias("_id"), F.xxhash64("text").alias("_text"))
    joined = rows.join(repeated_lines(docs, min_key), ["_id", "_text"], "left")
    return joined.select("row", _without(min_key)(F.col("row.text"), F.col("_gone")).alias("left")).select("row", "left.*")
