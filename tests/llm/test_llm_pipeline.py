import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from spendlens.llm import common, quality
from spendlens.llm.oracle import oracle
from spendlens.llm.queries import catalog

NAMES = ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


@pytest.fixture
def folder(spark, documents, tmp_path):
    def make(rows, labels, extra=False):
        documents(rows, extra).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


def test_every_query_is_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert sorted(int(n[2:].split("_")[0]) for n in catalog()) == list(range(1, 11))
    assert set(oracle()) <= set(catalog())
    assert set(catalog()) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages_take_effect(spark, folder):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]

    def prose(n):
        return " ".join(rng.choice(words, n)) + "."

    shared = "This line stands in many of the documents"
    rows, labels = [], []
    for i in range(120):
        junk = i % 6 == 0
        text = prose(60).upper().replace(" ", "!! ") if junk else prose(60) + "\n" + shared + "\n" + prose(20)
        rows.append((i, text, f"s{i % 3}"))
        if i % 2 == 0:
            labels.append((i, 0 if junk else 1, 0))
    rows += [(500 + i, rows[1 + i][1], "s0") for i in (0, 1, 2)]  # exact copies of clean documents
    path = folder(rows, labels)
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = corpus_pipeline.cut(docs)
        seen.append(docs.collect())
    good = {i for i, *_ in rows if i >= 500 or i % 6}
    assert {r.doc_id for r in seen[0]} == good
    assert sum(shared in r.text for r in seen[1]) == 1 and len(seen[1]) == len(seen[0])
    assert all(r.n_chars == len(r.text) for r in seen[1])
    # Copies lost their lines to the first document, and what is left of them is one document without words each.
    assert {r.doc_id for r in seen[2] if r.doc_id < 500} == {i for i in good if i < 500}
    taken = {}
    for r in seen[3]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert len(pieces) == len(seen[3])
    got = corpus_pipeline.run(spark, path).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, pieces))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_one_document_of_each_group_stays(spark, documents, odd_rows):
    docs = documents(odd_rows, extra=True)
    kept = corpus_pipeline.ngram_stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([0, 1, 2, 3, 4, 7, 8, None, None], key=str)


def test_rows_of_one_id_are_kept_or_dropped_alone(spark, documents):
    text = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(3, text), (5, text + " end"), (5, "something else of six words or more"), (8, other), (8, other + " end"), (9, ""), (9, "")]
    kept = corpus_pipeline.ngram_stage(spark, documents(rows, extra=True), "").collect()
    left = [(r.doc_id, r.text) for r in kept]
    assert sorted(x for x in left if x[0] < 8) == [rows[0], rows[2]]
    assert sum(i == 8 for i, _ in left) == 1 and left.count((9, "")) == 1 and len(left) == 4


def test_odd_and_empty_tables_go_through(spark, folder, odd_rows):
    path = folder(odd_rows, [(0, 1, 0), (1, None, None), (None, 0, 0)], extra=True)
    assert corpus_pipeline.run(spark, path).filter(F.col("length") > 1).count() > 0


def test_no_documents(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).collect() == []


def python_functions(plan):
    """Most Python functions that run together in one task of a physical plan; each takes a worker, which executors keep."""

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.inputPlan())
        children = node.children()
        found = [walk(children.apply(i)) for i in range(children.size())]
        here, most = sum(h for h, _ in found), max([m for _, m in found], default=0)
        if name == "Union":  # a task has rows of one of them only
            here = max(h for h, _ in found)
        here += "Pandas" in name or "Python" in name
        return (0, max(most, here)) if "Exchange" in name else (here, max(most, here))

    return walk(plan)[1]


def test_no_task_of_the_pipeline_needs_two_python_workers(spark, folder, monkeypatch):
    """Workers stay with their executor, so a task with two leaves twice the memory to all stages after it."""
    text = " ".join(f"w{i}" for i in range(60))
    path = folder([(i, f"{text} end{i}") for i in range(40)], [(i, i % 2, 0) for i in range(40)])
    counts, write = [], common.written

    def written(df, target):
        counts.append(python_functions(df._jdf.queryExecution().executedPlan()))
        return write(df, target)

    monkeypatch.setattr(common, "written", written)
    last = corpus_pipeline.run(spark, path)._jdf.queryExecution().executedPlan()
    assert max([*counts, python_functions(last)]) == 1
    # The layout of the sequences comes as rows, not by a job of Python workers.
    assert "ExistingRDD" not in last.toString()


def test_fitting_holds_the_views_once():
    """Beside the views themselves, fitting has room for the rows that it learns from, not for a second and third copy."""
    rng, n = np.random.default_rng(2), 3000
    words = [f"Word{i}" for i in range(200)]
    batch = pd.DataFrame({"text": [" ".join(rng.choice(words, 20)) for _ in range(n)], "lang": "en", "source": "s"})
    batch["label"] = pd.array([i % 2 if i < n // 2 else None for i in range(n)], dtype="Int32")
    size = n * (quality.SHAPES + 2) * 8
    tracemalloc.start()
    try:
        assert len(next(quality._fitted(n)(iter([batch])))) == 1
        assert tracemalloc.get_traced_memory()[1] < 2.2 * size
    finally:
        tracemalloc.stop()
