"""Bounded samples of labelled and unlabelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_by_hash(ids: DataFrame, rows: int) -> DataFrame:
    """The rows with the smallest hashes of ``doc_id``: a sample that does not depend on order or layout."""
    return ids.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows)


def labels_of(labels: DataFrame, label: Column) -> DataFrame:
    """One ``label`` per ``doc_id``; where rows disagree the larger one, NULLs left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).dropna()
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def fitting_sample(docs: DataFrame, labelled: DataFrame, most: int, most_unlabelled: int = 0) -> DataFrame:
    """At most so many labelled documents and, with a NULL ``label``, so many others.

    The two lists of ids are bounded by their parameters, so they are broadcast.
    """
    known = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    # Only labels whose document is there count, or a sample could come out empty.
    ids = known.select("doc_id").dropna().distinct()
    wanted = _first_by_hash(ids.join(labelled, "doc_id"), most)
    if most_unlabelled:
        others = _first_by_hash(ids.join(labelled, "doc_id", "left_anti"), most_unlabelled)
        wanted = wanted.unionByName(others.withColumn("label", F.lit(None).cast("int")))
    return known.join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"])
