"""The operators of this package as named queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import (
    bytebpe, lexical, line_dedup, mixing, packing, pii, quality, shingle_join, spelling, tokens, toxicity, vector_pairs,
    vector_search, warc,
)
from spendlens.llm.common import table

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    response = F.col("warc_type") == "response"
    stated = F.substring_index("warc_payload_digest", ":", -1)
    return records.select(
        warc.page_ids(F.col("warc_record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(stated).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        warc.page_ids(F.col("warc_refers_to")).alias("refers_to"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.span_digests(F.col("text")).alias("found")).select("doc_id", "found.*")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids, packed; the ids themselves are not shuffled."""
    pieces = tokens.token_pieces(docs, public_tokenizers.path(VOCABULARY), packing.CAPACITY)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents")).withColumn("length", F.col("length").cast("long"))


def op4_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pairs.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.quality(docs, model).alias("found")).select("doc_id", "found.*")
    return scored.withColumn("keep", F.col("score") >= quality.KEEP)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = shingle_join.shingle_components(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op7_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link_counts(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.toxicity(docs, weights).alias("found")).select("doc_id", "found.*")
    return scored.withColumn("held_out", toxicity.held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats")).alias("taken"),
        F.col("row.source").alias("source"),
        "repeats",
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")
    encoded = docs.select("doc_id", bytebpe.there_and_back(F.col("text"), *vocabulary).alias("found"))
    return encoded.select(
        "doc_id",
        (F.octet_length("found.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("found.ids", 256).alias("ids_sha256"),
        F.sha2("found.decoded", 256).alias("decoded_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc, op2_pii, op3_packing, op4_vector_pairs, op5_vector_search,
        op6_quality, op7_ngram_join, op8_line_dedup, op9_toxicity, op10_mixing,
        op11_spelling, op12_byte_bpe, op13_lexical_search,
    )
}

#: Further outputs of operators, not among those that count once per operator.
MORE: dict[str, Query] = {"op7_ngram_links": op7_ngram_links}


def catalog() -> dict[str, Query]:
    return dict(QUERIES)
