"""A corpus pipeline of the operators in ``spendlens.llm``: each stage works on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import line_dedup, mixing, quality, shingle_join
from spendlens.llm.common import cut, table
from spendlens.llm.queries import packed_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of the documents that are there."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.quality(docs, model)["score"] >= quality.KEEP)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that only had such lines is left empty."""
    left = line_dedup.without_repeated_lines(docs)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; rows, not ids, are kept or dropped.

    Equal rows are one document. Rows without an id join groups, but none of them
    is dropped as a copy.
    """
    # Written once, so that the numbers of the rows stay.
    rows = cut(docs.withColumn("_ngram_row", F.monotonically_increasing_id()))
    groups = shingle_join.shingle_components(rows.select(F.col("_ngram_row").alias("doc_id"), "text"))
    ids = rows.filter("doc_id is not null").select("doc_id", "_ngram_row")
    members = ids.join(groups.select(F.col("doc_id").alias("_ngram_row"), "component_id"), "_ngram_row")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_ngram_row")).alias("least")).select("least._ngram_row")
    kept = rows.join(first, "_ngram_row", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(rows.filter("doc_id is null")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, copies from the mix included, each at its place in a sequence."""
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

# A trained classifier and a packing heuristic cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
