"""Quality of documents by co-training on two views.

One classifier reads the text: how its words are spelled (shapes such as ``Aa`` or
``A!``) and how often one repeats the word before. The other never reads words: it
knows the page's language, source, size and layout, that is the shares of
character classes, lines and distinct words.

Both start from the same labelled documents. In each round either labels the
unlabelled documents it is surest of, and these join the other's examples. At the
end both are calibrated on labelled documents that neither has learned from, and the
calibrated log odds are combined, again on those.

Fitting takes at most ``LABELLED`` labelled and ``UNLABELLED`` other documents, in
one task that holds nothing else. All documents are scored, over whole texts.

Defined results: NULL and empty texts are scored by what is known of them; without
labels, or with one label only, every document gets the smoothed share of good
labels; of labels that disagree the larger one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spendlens.llm.samples import fitting_sample, labels_of

LABELLED, UNLABELLED = 6000, 6000
SHAPES, NAMES = 1024, 64
ROUNDS = 4
SURE = 0.95  # probability from which a pseudo-label may be given
PER_ROUND = 600  # pseudo-labels a view gives in a round, at most
KEEP = 0.3  # a good document lost costs more than a bad one kept
CACHED_WORDS, CACHED_LENGTH = 400_000, 64  # longer words are read whole each time

_UPPER, _LOWER, _DIGITS = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[a-zß-öø-ÿ]+"), re.compile("[0-9]+")
_REPEATED = re.compile(r"(.)\1+")


class Shapes(dict):
    """Hashed shape of a word: runs of capitals, small letters and digits, and marks, each once."""

    def __missing__(self, word: str) -> int:
        shape = _DIGITS.sub("9", _LOWER.sub("a", _UPPER.sub("A", word)))
        at = xxh3_64_intdigest(_REPEATED.sub(r"\1", shape)) % SHAPES
        if len(word) <= CACHED_LENGTH:
            if len(self) > CACHED_WORDS:
                self.clear()
            self[word] = at
        return at


def text_view(words: list[str], shapes: Shapes) -> np.ndarray:
    out = np.zeros(SHAPES + 2)
    out[-1] = 1
    if words:
        out[:SHAPES] = np.sqrt(np.bincount([shapes[w] for w in words], minlength=SHAPES) / len(words))
        out[-2] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    return out


def _class_masks() -> np.ndarray:
    chars = [chr(i) for i in range(256)]
    tests = (str.isupper, str.islower, str.isdigit, str.isspace, lambda c: not c.isalnum() and not c.isspace())
    return np.array([[bool(t(c)) for c in chars] for t in tests], float)


CLASSES = _class_masks()
LAYOUT = len(CLASSES) + 5


def meta_view(text: str, words: list[str], lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(LAYOUT + NAMES + 1)
    size = max(1, len(text))
    classes = np.bincount(np.frombuffer(text.encode("latin-1", "replace"), np.uint8), minlength=256)
    lines = text.count("\n") + 1
    out[: len(CLASSES)] = np.sqrt(CLASSES @ classes / size)
    out[len(CLASSES) : LAYOUT] = (
        np.log1p(len(text)), np.log1p(lines), np.log1p(len(text) / lines),
        len(set(words)) / max(1, len(words)), len(words) / size,
    )
    for name in (f"lang:{lang}", f"source:{source}"):
        out[LAYOUT + xxh3_64_intdigest(name) % NAMES] = 1
    out[-1] = 1
    return out


def views(frame: pd.DataFrame, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Both views of each row of ``text, lang, source``."""
    texts, metas = [], []
    for text, lang, source in frame[["text", "lang", "source"]].itertuples(index=False):
        text = text if isinstance(text, str) else ""
        words = text.split()
        texts.append(text_view(words, shapes))
        metas.append(meta_view(text, words, lang, source))
    return np.array(texts).reshape(-1, SHAPES + 2), np.array(metas).reshape(-1, LAYOUT + NAMES + 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 250, start: np.ndarray | None = None) -> np.ndarray:
    """Weights by Adam on the regularised likelihood; the last column of x is the constant."""
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = x.T @ (_sigmoid(x @ w) - y) / len(y)
        grad[:-1] += l2 * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


@dataclass
class Model:
    """Scaling and weights of both views, their calibrations, and the combination. Every part is small."""

    centre: np.ndarray
    spread: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    text_line: np.ndarray  # slope and constant
    meta_line: np.ndarray
    joint: np.ndarray

    def scaled(self, meta: np.ndarray) -> np.ndarray:
        return (meta - self.centre) / self.spread

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: calibrated text view, calibrated metadata view, both together."""
        a = np.stack([text @ self.text, np.ones(len(text))], 1) @ self.text_line
        b = np.stack([self.scaled(meta) @ self.meta, np.ones(len(text))], 1) @ self.meta_line
        return _sigmoid(np.stack([a, b, np.stack([a, b, np.ones(len(a))], 1) @ self.joint], 1))


def _confident(odds: np.ndarray, share_good: float) -> tuple[np.ndarray, np.ndarray]:
    """The surest rows of either kind, in the proportion of the labelled ones."""
    p = _sigmoid(odds)
    good = np.argsort(-p, kind="stable")[: int(np.ceil(PER_ROUND * share_good))]
    bad = np.argsort(p, kind="stable")[: int(np.ceil(PER_ROUND * (1 - share_good)))]
    rows = np.concatenate([good[p[good] >= SURE], bad[p[bad] <= 1 - SURE]]).astype(int)
    return rows, (p[rows] >= 0.5).astype(float)


def co_train(text: np.ndarray, meta: np.ndarray, labels: np.ndarray) -> Model:
    """Fit on rows whose label is 0, 1 or NaN for unlabelled. Every fourth labelled row is kept for calibration."""
    known = np.flatnonzero(~np.isnan(labels))
    pool = np.flatnonzero(np.isnan(labels))
    good = (labels[known].sum() + 1) / (len(known) + 2)
    prior = np.log(good / (1 - good))
    centre, spread = np.zeros(meta.shape[1]), np.ones(meta.shape[1])
    if len(meta):
        centre[:LAYOUT] = meta[:, :LAYOUT].mean(0)
        spread[:LAYOUT] = meta[:, :LAYOUT].std(0) + 1e-6
    model = Model(
        centre, spread, np.zeros(text.shape[1]), np.zeros(meta.shape[1]), np.array([0, prior]), np.array([0, prior]),
        np.array([0.5, 0.5, 0]),
    )
    if len(set(labels[known])) < 2:
        return model
    own, held = known[np.arange(len(known)) % 4 != 0], known[::4]
    meta = model.scaled(meta)
    rows = {"text": own, "meta": own}
    answers = {"text": labels[own], "meta": labels[own]}
    for turn in range(ROUNDS + 1):
        model.text = logistic(text[rows["text"]], answers["text"], start=model.text)
        model.meta = logistic(meta[rows["meta"]], answers["meta"], start=model.meta)
        if turn == ROUNDS or not len(pool):
            break
        given = []
        for view, odds in (("meta", (text @ model.text)[pool]), ("text", (meta @ model.meta)[pool])):
            chosen, marks = _confident(odds, good)
            rows[view] = np.concatenate([rows[view], pool[chosen]])
            answers[view] = np.concatenate([answers[view], marks])
            given.append(chosen)
        pool = np.delete(pool, np.unique(np.concatenate(given)))
    y = labels[held]
    for view, x in (("text", text), ("meta", meta)):
        line = np.stack([x[held] @ getattr(model, view), np.ones(len(held))], 1)
        setattr(model, f"{view}_line", logistic(line, y, 1e-2, start=np.array([1.0, 0.0])))
    both = ((text, model.text, model.text_line), (meta, model.meta, model.meta_line))
    odds = [np.stack([x[held] @ w, np.ones(len(held))], 1) @ line for x, w, line in both]
    model.joint = logistic(np.stack([*odds, np.ones(len(held))], 1), y, 1e-2, start=np.array([0.5, 0.5, 0.0]))
    return model


FIELDS = list(Model.__dataclass_fields__)


def _fitted(most: int):
    """One model from all rows, ``most`` at the most, of the one partition that holds the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Filled in place, so the views are held once.
        text, meta, label = np.zeros((most, SHAPES + 2)), np.zeros((most, LAYOUT + NAMES + 1)), np.zeros(most)
        shapes, rows = Shapes(), 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                own = slice(rows, rows + len(part))
                text[own], meta[own] = views(part, shapes)
                label[own] = part["label"].to_numpy(float, na_value=np.nan)
                rows += len(part)
        model = co_train(text[:rows], meta[:rows], label[:rows])
        yield pd.DataFrame({f: [getattr(model, f).astype(float).tobytes()] for f in FIELDS})

    return run


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    """Fit both views on bounded samples of ``docs`` (doc_id, text, lang, source)."""
    rows = fitting_sample(docs.select("doc_id", "text", "lang", "source"), labels_of(labels, F.col("quality")), labelled, unlabelled)
    ordered = rows.repartition(1).sortWithinPartitions("doc_id")
    row = ordered.mapInPandas(_fitted(labelled + unlabelled), ", ".join(f"{f} binary" for f in FIELDS)).first()
    if row is None:  # no rows, so no task either
        return co_train(np.zeros((0, SHAPES + 2)), np.zeros((0, LAYOUT + NAMES + 1)), np.zeros(0))
    return Model(*(np.frombuffer(row[f]) for f in FIELDS))


def quality(docs: DataFrame, model: Model) -> Column:
    """Struct ``text_score, meta_score, score`` (0 to 1, higher: better) for columns text, lang, source."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text_score double, meta_score double, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for text, lang, source in batches:
            frame = pd.DataFrame({"text": text, "lang": lang, "source": source})
            parts = [shared.value.scores(*views(frame.iloc[i : i + 500], shapes)) for i in range(0, len(frame), 500)]
            yield pd.DataFrame(np.concatenate([*parts, np.zeros((0, 3))]), columns=["text_score", "meta_score", "score"])

    return run(F.col("text"), F.col("lang"), F.col("source"))
