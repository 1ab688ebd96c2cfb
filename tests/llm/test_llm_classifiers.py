import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import quality, samples, toxicity

SF = "/root/testdata/sf0.01"


def plain(rng, n):
    return " ".join(rng.choice(["river", "stone", "walks", "The", "under", "light.", "evening", "of", "near,"]) for _ in range(n))


def toxic_corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [plain(rng, rng.randint(4, 12)) + "." for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] = f"{plain(rng, 3)} {rng.choice(['grumbold', 'grumboldish', 'snarkel', 'snarkels'])} {plain(rng, 2)}."
        rows.append((i, " ".join(parts), int(toxic)))
    return rows


def test_sentences_cover_the_text():
    for text in ("One. Two! Three?\nFour", "no end", "", None, "a.b c", "...\n\n", "x" * 100_000, "Ä. 🙂? B"):
        spans = toxicity.sentences(text)
        assert "".join((text or "")[a:b] for a, b in spans) == (text or "")


def test_noisy_or_learns_words_and_finds_the_sentence():
    rows = toxic_corpus()
    weights = toxicity.fit([t for _, t, _ in rows[:180]], np.array([y for *_, y in rows[:180]]))
    scorer = toxicity.Scorer(weights)
    for _, text, label in rows[180:]:
        score, start, end, worst = scorer.score(text)
        assert (score >= toxicity.THRESHOLD) == bool(label) and 0 <= score <= 1
        assert worst <= score + 1e-9
        if label:
            assert "grumbold" in text[start:end] or "snarkel" in text[start:end]
    # A word never seen shares its beginning with one that was.
    assert scorer.score("Such a grumboldest thing.")[0] > toxicity.THRESHOLD


def test_score_is_the_noisy_or_of_its_sentences():
    weights = np.zeros(toxicity.DIMENSIONS + 1)
    weights[-1] = -1.0
    assert toxicity.Scorer(weights).score("a b. c d. e")[0] == pytest.approx(1 - (1 - 1 / (1 + np.exp(1.0))) ** 3)


def test_slope_lowers_the_loss():
    rows = toxic_corpus(80)
    texts, labels = [t for _, t, _ in rows], np.array([y for *_, y in rows])

    def loss(w):
        p = np.array([toxicity.Scorer(w).score(t)[0] for t in texts])
        return -np.log(np.where(labels == 1, p, 1 - p)).mean()

    losses = [loss(toxicity.fit(texts, labels, steps)) for steps in (0, 10, 60)]
    assert losses[0] > losses[1] > losses[2]


def test_held_out_rule_and_unseen_labels(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())
    rows = [(i, t) for i, t, _ in toxic_corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    right = [(i, 0, y) for i, _, y in toxic_corpus()]
    held = {i for i, *_ in right if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [(i, 0, 1 - y if i in held else y) for i, _, y in right]
    schema = "doc_id long, quality int, toxic int"
    models = [toxicity.train(docs, spark.createDataFrame(x, schema)) for x in (right, wrong)]
    assert (models[0] == models[1]).all() and (models[0] != 0).sum() > 1


def test_odd_rows_get_a_score(spark, documents, odd_rows):
    docs = documents(odd_rows, extra=True)
    labels = spark.createDataFrame([(0, 1, 1), (4, 0, None), (4, 1, 0), (5, 0, 0), (None, 1, 1), (777, 1, 1)], "doc_id long, quality int, toxic int")
    weights = toxicity.train(docs, labels)
    got = docs.select("doc_id", "text", toxicity.toxicity(docs, weights).alias("f")).select("doc_id", "text", "f.*").collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 and r.start is None for r in got if not r.text)
    none = toxicity.train(documents([]), labels)
    assert (none[:-1] == 0).all()
    assert documents([]).select(toxicity.toxicity(docs, none)).collect() == []


def test_sample_is_bounded_and_stable(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(300)] + [(5, "again")])
    labels = samples.labels_of(spark.createDataFrame([(i, i % 2) for i in range(100)] + [(0, 1), (1, None)], "doc_id long, q int"), F.col("q"))
    rows = samples.fitting_sample(docs, labels, 40, 30)
    first = {(r.doc_id, r.label) for r in rows.collect()}
    assert sum(y is not None for _, y in first) == 40 and sum(y is None for _, y in first) == 30
    assert all(i >= 100 for i, y in first if y is None)
    assert first == {(r.doc_id, r.label) for r in samples.fitting_sample(docs.repartition(9), labels.repartition(3), 40, 30).collect()}
    assert {r.label for r in labels.filter("doc_id in (0, 1)").collect()} == {1}


def test_accuracy_on_documents_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.filter("doc_id % 3 > 0")
    rest = docs.join(labels.filter("doc_id % 3 = 0"), "doc_id")
    model = quality.train(docs, learn)
    scored = rest.select("quality", quality.quality(rest, model).alias("s")).select("quality", "s.*").collect()
    for view in ("text_score", "meta_score", "score"):
        assert np.mean([(r[view] >= 0.5) == (r.quality == 1) for r in scored]) > 0.97
    assert np.mean([r.score >= quality.KEEP for r in scored if r.quality == 1]) > 0.99
    weights = toxicity.train(docs, labels)
    held = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    scored = held.select("toxic", toxicity.toxicity(held, weights).alias("s")).select("toxic", "s.*").collect()
    assert np.mean([(r.score >= toxicity.THRESHOLD) == (r.toxic == 1) for r in scored]) > 0.9


def views_of(rows):
    import pandas as pd

    return quality.views(pd.DataFrame(rows, columns=["text", "lang", "source"]), quality.Shapes())


def test_pseudo_labels_teach_the_other_view():
    """Few labels leave the text view unsure; what the layout is sure of makes up for it."""
    rng = np.random.default_rng(0)
    n = 1200
    y = (rng.random(n) < 0.7).astype(float)
    text, meta = np.zeros((n, quality.SHAPES + 2)), np.zeros((n, quality.LAYOUT + quality.NAMES + 1))
    text[:, -1] = meta[:, -1] = 1
    for j in range(40):
        text[:, j] = rng.random(n) < np.where(y == 1, 0.35, 0.15)
    meta[:, 0] = y + rng.normal(size=n) * 0.15
    labels = np.where(np.arange(n) < 24, y, np.nan)

    def text_accuracy():
        model = quality.co_train(text, meta, labels)
        return np.mean((text[24:] @ model.text > 0) == y[24:])

    with_rounds = text_accuracy()
    quality.ROUNDS, kept = 0, quality.ROUNDS
    try:
        alone = text_accuracy()
    finally:
        quality.ROUNDS = kept
    assert with_rounds > alone + 0.03


def test_quality_without_labels_or_with_one_kind(spark, documents, odd_rows):
    docs, schema = documents(odd_rows, extra=True), "doc_id long, quality int, toxic int"
    for rows, share in (([], 0.5), ([(0, 1, 0), (4, 1, 0)], 0.75)):
        model = quality.train(docs, spark.createDataFrame(rows, schema))
        got = docs.select(quality.quality(docs, model).alias("s")).select("s.*").collect()
        assert len(got) == len(odd_rows)
        assert all(r.text_score == pytest.approx(share) and r.score == pytest.approx(share) for r in got)
    assert documents([]).select(quality.quality(docs, model)).collect() == []
    empty = quality.train(documents([]), spark.createDataFrame([(0, 1, 0)], schema))
    assert empty.joint.tolist() == [0.5, 0.5, 0]


def test_views_of_odd_texts():
    text, meta = views_of([(None, None, None), ("", "en", "s"), ("퟿🙂", "en", None), ("A" * 200_000, "en", "s")])
    assert np.isfinite(text).all() and np.isfinite(meta).all() and text.shape[0] == 4


def test_shapes_are_of_whole_words():
    shapes = quality.Shapes()
    for n in (10, 64, 65, 100_000):
        assert shapes["a" * n + "A1!"] == shapes["aA1!"] != shapes["a"]
    assert max(map(len, shapes)) <= quality.CACHED_LENGTH
    long = ["a" * 64 + "!" * 500]
    assert (quality.text_view(long, shapes) != quality.text_view(["a" * 64], shapes)).any()
