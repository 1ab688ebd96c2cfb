"""The queries that write intermediates, off local mode with a mounted folder."""

import pytest

from spendlens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    words = [f"spelling{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(200)]
    texts = ["\n".join(" ".join(words[(i + 3 * j) % 190 :][:9]) for j in range(6)) for i in range(24)]
    docs = documents([(i, t, f"s{i % 3}") for i, t in enumerate([*texts, *texts[:4], "", None])])
    # About a direction each, in pairs.
    vectors = [(i, [float((i // 2 * 7 + 3 * d) % 11) - 5 + 0.001 * (i % 2) for d in range(8)], i % 3) for i in range(60)]
    tables = {
        "documents": docs,
        "labels": docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 3 = 0 as int) as toxic"),
        "benchmark": spark.createDataFrame([(i, texts[i][:60]) for i in range(5)], "item_id long, text string"),
        "pages": spark.createDataFrame(
            [(i, f"http://h{i % 4}.example/{i}", f"<html><body>page {i % 9}{' x' * 40}</body></html>") for i in range(30)],
            "page_id long, url string, html string",
        ),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def same_off_local_mode(spark, monkeypatch, query, folder):
    rows = lambda: sorted(str(r) for r in query(spark, folder).collect())
    want = rows()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert rows() == want and want


WRITERS = [
    "op1_warc", "op3_packing", "op4_vector_pairs", "op5_vector_search", "op7_ngram_join",
    "op8_line_dedup", "op10_mixing", "op11_spelling", "op13_lexical_search",
]


@pytest.mark.parametrize("name", WRITERS)
def test_query_is_the_same(spark, monkeypatch, folder, name):
    same_off_local_mode(spark, monkeypatch, QUERIES[name], folder)
