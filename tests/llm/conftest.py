import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builder of small document tables: a list of texts, or of (doc_id, text[, source])."""

    def build(rows, extra=False):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, *source = row if isinstance(row, tuple) else (i, row)
            full.append((doc_id, text, "en", source[0] if source else "s", None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that operators use for their own columns
            for name in ("size", "row", "rest", "_id", "node", "n", "label", "length", "piece", "key", "score", "left", "_key"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build


ODD = [
    (0, "one two three four five six seven"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "word"),
    (5, "one two three four five six seven"),
    (6, "One  TWO three\nfour five six seven"),
    (None, "one two three four five six seven"),
    (None, "a line of its own that no other holds"),
    (7, "long " * 30000 + "end"),
    (8, "Ünïcode ß İstanbul ﬁ 日本語 text 🙂 here too and more"),
    (4, "word"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
