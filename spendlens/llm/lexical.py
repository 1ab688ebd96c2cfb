"""Ranked lexical search: every document is scanned for the terms of a set of items, without an index of documents.

The terms of all items form one Aho-Corasick automaton. Each term stands between two
boundary signs and so does each run of letters and digits of a text, so the automaton
finds whole terms only, and its output leads from the term to the items that hold it.
A first scan counts documents, terms and the documents that hold each term; from these
come the weights of terms. A second scan counts the terms of each document again,
adds up the scores of all items that they lead to and keeps the best documents of each
item in heaps, so a task passes on no more rows than it keeps. All counts are sums over
all documents, and scores are whole numbers.

Items are stated, not found: they are cut into blocks of at most ``BLOCK_BYTES`` of
terms, each with an automaton of its own that is sent to every task, and documents are
scanned once more for every further block.

Defined results: rows that share an ``item_id`` are one item with the terms of all; an
item without terms, or of which no document holds a term, has no rows; a NULL or empty
text has no terms and does not count as a document; rows that repeat a ``doc_id`` are
documents of their own; a document without an id comes after all others of its score;
terms and texts may have any length; empty tables give no rows; other columns are not
looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import cut

BEST = 10
BLOCK_BYTES = 16 * 1024 * 1024
MERGED_BY = 64  # groups of tasks whose best documents are merged first
LAST_ID = 2**63 - 1

# All ASCII but letters and digits parts terms; only A to Z are lower-cased. As bytes of UTF-8.
BOUNDARY = b" "
SIGNS = bytes(c if chr(c).isalnum() or c > 127 else BOUNDARY[0] for c in range(128)) + bytes(range(128, 256))
SIGNS = SIGNS.lower()


def signs(text: str | None) -> bytes:
    """A text as terms between boundary signs."""
    return BOUNDARY + (text or "").encode("utf-8", "surrogatepass").translate(SIGNS) + BOUNDARY


class TermScanner:
    """Counts given terms in texts."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            # A character stands for a byte.
            guarded = BOUNDARY + term.encode("utf-8", "surrogatepass") + BOUNDARY
            self.automaton.add_word(guarded.decode("latin-1"), number)
        if terms:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, Counter]:
        """Number of all terms of a text, and how often it holds each given one, by number."""
        guarded = signs(text)
        found = self.automaton.iter(guarded.decode("latin-1")) if len(self.automaton) else ()
        return len(guarded.split()), Counter(map(itemgetter(1), found))


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(terms: int, documents: int, all_terms: int) -> int:
    return 100 - 90 + (90 * terms * documents) // all_terms


class ItemBlock:
    """Terms of some items: ``terms``, and by term the places of the items that hold it."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.items = [item for item, _ in rows]
        places: dict[str, list[int]] = {}
        for place, (_, terms) in enumerate(rows):
            for term in terms:
                places.setdefault(term, []).append(place)
        self.terms = sorted(places)
        self.holders = [np.array(places[t], np.int64) for t in self.terms]


def _first_scan(shared):
    """Sums of each task: documents that hold each term, then documents (-1) and terms (-2) in all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, held, documents, all_terms = TermScanner(shared.value.terms), Counter(), 0, 0
        for batch in batches:
            for text in batch["text"]:
                n, found = scanner.scan(text)
                documents += n > 0
                all_terms += n
                held.update(found.keys())
        held[-1], held[-2] = documents, all_terms
        yield pd.DataFrame(held.items(), columns=["term", "n"])

    return run


def _second_scan(shared, best: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, weights, documents, all_terms = shared.value
        scanner = TermScanner(block.terms)
        kept: list[list[tuple[int, int]]] = [[] for _ in block.items]
        # What a document must reach to be kept: the least score of a full heap.
        least = np.ones(len(block.items), np.int64)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                n, found = scanner.scan(text)
                if not found:
                    continue
                spread = 8 * length_factor(n, documents, all_terms)
                scores = np.zeros(len(block.items), np.int64)
                for term, tf in found.items():
                    # An item is named once among the holders of a term.
                    scores[block.holders[term]] += weights[term] * ((1_000_000_000 * tf) // (1000 * tf + spread))
                for place in np.flatnonzero(scores >= least):
                    heap, entry = kept[place], (int(scores[place]), -int(doc_id))
                    if len(heap) < best:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == best:
                        least[place] = heap[0][0]
        part = TaskContext.get().partitionId() % MERGED_BY
        rows = [(part, item, -doc, score) for item, heap in zip(block.items, kept, strict=True) for score, doc in heap]
        table = pd.DataFrame(rows, columns=["part", "item_id", "doc_id", "score"])
        yield table.astype({"part": "int64", "item_id": object, "doc_id": "int64", "score": "int64"})

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms``: the different terms of each item that has any."""

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({t.decode() for t in signs(text).split()}) for text in texts])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.explode(terms(F.col("text"))).alias("term"))
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _blocks(items: DataFrame, most: int) -> Iterator[ItemBlock]:
    """Items in blocks of so many bytes of terms at most, or of one item; the driver holds one block at a time."""
    rows: list[tuple] = []
    size = 0
    for row in items.toLocalIterator():
        own = sum(len(t) + 64 for t in row.terms)
        if rows and size + own > most:
            yield ItemBlock(rows)
            rows, size = [], 0
        rows.append((row.item_id, row.terms))
        size += own
    if rows:
        yield ItemBlock(rows)


def best_documents(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the documents that score highest for each item."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "text")
    schema, kind = "item_id string, doc_id long, score long", items.schema["item_id"].dataType
    found = spark.createDataFrame([], schema)
    for block in _blocks(cut(item_terms(items)), block_bytes):
        counts = texts.mapInPandas(_first_scan(spark.sparkContext.broadcast(block)), "term long, n long")
        # One number for each term of the block.
        held = dict(counts.groupBy("term").agg(F.sum("n")).collect())
        documents, all_terms = held.get(-1, 0), held.get(-2, 0)
        weights = [term_weight(documents, held.get(i, 0)) for i in range(len(block.terms))]
        plan = spark.sparkContext.broadcast((block, weights, documents, all_terms))
        scored = texts.mapInPandas(_second_scan(plan, best), f"part long, {schema}")
        found = found.union(_first(scored, best, "part").select("item_id", "doc_id", "score"))
    ranked = _first(found.select("item_id", "doc_id", "score"), best)
    doc_id: Column = F.when(F.col("doc_id") != LAST_ID, F.col("doc_id"))
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", doc_id.alias("doc_id"), "score")


def _first(rows: DataFrame, best: int, *further: str) -> DataFrame:
    order = Window.partitionBy("item_id", *further).orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(
        "item_id", "rank", "doc_id", "score"
    )
