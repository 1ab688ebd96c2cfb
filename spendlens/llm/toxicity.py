"""Toxic documents by multiple-instance learning.

A document is a bag of sentences. Each sentence has the probability sigma(b + sum of
the weights of its words'
features), and the document is toxic unless no sentence is: a noisy
or. Only document labels are known; their likelihood teaches the weights, and the
sentence probabilities then say where the offence is.

The model is fitted on at most ``SAMPLE`` labelled documents, in one task that holds
nothing else; all documents are scored, over whole texts. Only the text enters a
score. A word counts by itself and by its beginnings, which its inflections share;
features that the sample does not tie to toxic documents are left out when fitting.

Defined results: an empty or NULL text has no sentence, so its score is 0; without
any labelled document all scores are those of the untrained model; a document
without an id is never held out and never learned from; of labels that disagree
the larger one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spendlens.llm.samples import fitting_sample, labels_of

SAMPLE = 8_000
DIMENSIONS = 2**20
PREFIXES = (4, 5, 6, 7)
MIN_DOCS = 3
MIN_SIGNAL = 3.0  # standard deviations
CACHED_WORDS = 400_000
STEPS = 120
RATE = 0.1
L2 = 1e-4
BIAS = -6.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

SENTENCE_END = re.compile(r"[.!?]+\s+|\n+")
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Documents that labels are never learned from."""
    fold = F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences in code points; every word lies in one."""
    spans, start, text = [], 0, text or ""
    for m in SENTENCE_END.finditer(text):
        spans.append((start, m.end()))
        start = m.end()
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, which inflected and compound words share."""
    parts = [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [xxh3_64_intdigest(p) % DIMENSIONS for p in parts]


def sentence_words(text: str | None) -> tuple[list[tuple[int, int]], list[set[str]]]:
    """Spans and distinct words of the sentences."""
    spans = sentences(text)
    return spans, [set(WORD.findall(text[start:end].lower())) for start, end in spans]


def log_clean(odds: np.ndarray) -> np.ndarray:
    """Logarithm of one minus the probability."""
    return -np.logaddexp(0, odds)


def _telling(texts: list[str | None], labels: np.ndarray) -> np.ndarray:
    """Which features are in clearly more toxic documents than chance would have it."""
    count, toxic = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for text, label in zip(texts, labels, strict=True):
        words = set(WORD.findall((text or "").lower()))
        own = np.fromiter({f for w in words for f in word_features(w)}, np.int64)
        count[own] += 1
        toxic[own] += label
    base = min(0.999, max(0.001, float(np.mean(labels)) if len(labels) else 0.5))
    usual = np.sqrt(np.maximum(count, 1) * base * (1 - base))
    return (count >= MIN_DOCS) & (toxic - count * base > MIN_SIGNAL * usual)


def _entries(texts: list[str | None], telling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Telling features one after the other, the sentence of each, and the number of sentences of each text."""
    features, owner, counts, at = [], [], [], 0
    for text in texts:
        spans, words = sentence_words(text)
        known = {w: [f for f in word_features(w) if telling[f]] for w in set().union(*words)}
        for own in words:
            for word in own:
                features += known[word]
                owner += [at] * len(known[word])
            at += 1
        counts.append(len(spans))
    return np.array(features, np.int64), np.array(owner, np.int64), np.array(counts, np.int64)


def fit(texts: list[str | None], labels: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights by Adam on the likelihood of the document labels; the last one is the bias."""
    weights = np.zeros(DIMENSIONS + 1)
    weights[-1] = BIAS
    kept = [i for i, t in enumerate(texts) if t]
    if not kept:
        return weights
    texts, labels = [texts[i] for i in kept], np.asarray(labels, float)[kept]
    features, owner, counts = _entries(texts, _telling(texts, labels))
    first, doc = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    used, features = np.unique(features, return_inverse=True)
    w = np.append(np.zeros(len(used)), BIAS)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        odds = np.bincount(owner, w[features], minlength=len(doc)) + w[-1]
        clean = np.minimum(-1e-12, np.add.reduceat(log_clean(odds), first))
        # Slope of the loss by a sentence's log odds.
        p = 1 / (1 + np.exp(-odds))
        pull = np.where(labels == 1, -np.exp(clean) / -np.expm1(clean), 1.0)
        slope = p * pull[doc] / len(labels)
        grad = np.append(np.bincount(features, slope[owner], minlength=len(used)), slope.sum())
        grad[:-1] += L2 * w[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights[used], weights[-1] = w[:-1], w[-1]
    return weights


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One model from all rows of the one partition that holds the sample."""
    rows = pd.concat([b[["text", "label"]] for b in batches] or [pd.DataFrame({"text": [], "label": []})])
    yield pd.DataFrame({"weights": [fit(rows["text"].tolist(), rows["label"].to_numpy()).astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from labelled documents that are not held out."""
    known = labels_of(labels, F.col("toxic")).filter(~held_out(F.col("doc_id")))
    rows = fitting_sample(docs.select("doc_id", "text"), known, sample)
    ordered = rows.select("doc_id", "text", "label").repartition(1).sortWithinPartitions("doc_id")
    model = ordered.mapInPandas(_fitted, "weights binary").first()
    if model is None:  # no rows, so no task either
        return fit([], np.zeros(0))
    return np.frombuffer(model.weights, np.float32).astype(np.float64)


class Scorer(dict):
    """Weights of words, summed over their features when first asked for."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = total = float(self.weights[word_features(word)].sum())
        return total

    def score(self, text: str | None) -> tuple[float, int | None, int | None, float | None]:
        """Score of a text; start, end and probability of its worst sentence."""
        spans, words = sentence_words(text)
        if not spans:
            return 0.0, None, None, None
        odds = np.array([sum(map(self.__getitem__, own)) for own in words]) + self.weights[-1]
        worst = int(odds.argmax())
        return float(-np.expm1(log_clean(odds).sum())), *spans[worst], float(1 / (1 + np.exp(-odds[worst])))


def toxicity(docs: DataFrame, weights: np.ndarray) -> Column:
    """Struct of ``score`` and the worst sentence (``start``, ``end``, ``sentence_score``) for a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("score double, start int, end int, sentence_score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield typed([scorer.score(t) for t in texts])

    def typed(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["score", "start", "end", "sentence_score"])
        return frame.astype({"start": "Int32", "end": "Int32", "sentence_score": "Float64"})

    return run(F.col("text"))
