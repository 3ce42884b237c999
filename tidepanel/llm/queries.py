"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (
    bpe,
    codes,
    counts,
    fingerprint,
    language,
    neardup,
    neighbours,
    packing,
    quality,
    resample,
    search,
    sharding,
    shared,
    toxicity,
)
from tidepanel.llm.queries_sql import ORACLES as ORACLES

SHARDS = 8
NEIGHBOURS = 5
NEAR = neardup.Shape(width=3, percent=85)
EVERY = 50
ALIKE = 0.9  # likeness of fingerprints from which on op10 groups texts


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = shared.table(spark, sf_dir, "documents")
    model = quality.fit(docs, shared.table(spark, sf_dir, "labels"))
    return quality.predict(docs.select("doc_id", shared.held_out(), "text"), model, ("doc_id", "held_out"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    sharded = sharding.byte_shards(shared.table(spark, sf_dir, "documents"), SHARDS)
    return sharded.withColumn("grown_shard", F.lit(None).cast("int"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = shared.table(spark, sf_dir, "documents")
    model = language.fit(docs, language.trainable(docs))
    return language.predict(docs.select("doc_id", shared.held_out(), "text"), model, ("doc_id", "held_out"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as pieces packed into sequences of 4096 tokens."""
    docs = shared.table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = shared.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.predict(docs.select("doc_id", shared.held_out(), "text"), model, ("doc_id", "held_out"))


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by integer inner product, of every fiftieth one."""
    vectors = shared.table(spark, sf_dir, "embeddings").filter(search.usable("embedding"))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), search.quantised("embedding").alias("vector"))
    return search.top_k(vectors.filter(F.col("vec_id") % EVERY == 0), vectors, NEIGHBOURS)


def op7_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the bytes they decode to, as digests."""
    docs = shared.table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 85 per cent of their shingles of three words."""
    return neardup.near_duplicates(shared.table(spark, sf_dir, "documents"), NEAR)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    docs = shared.table(spark, sf_dir, "documents")
    return counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the group of like fingerprints it is in."""
    prints = fingerprint.compare_with_next(shared.table(spark, sf_dir, "documents"))
    return fingerprint.with_groups(prints, ALIKE)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the distribution of the benchmark's texts."""
    return resample.resample(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found, by cosine, of every fiftieth one."""
    vectors = shared.table(spark, sf_dir, "embeddings")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(vectors.filter(F.col("vec_id") % EVERY == 0), vectors, NEIGHBOURS)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in four parts of 256 entries each, and their errors."""
    vectors = shared.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    coded, codebooks = codes.product_codes(vectors)
    return coded.select(
        "vec_id", "code", "error", "label_error", F.lit(codes.digest(codebooks)).alias("codebooks_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_shards": op2_shards,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_search": op6_search,
    "op7_bytes": op7_bytes,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_resampling": op11_resampling,
    "op12_neighbours": op12_neighbours,
    "op13_vector_codes": op13_vector_codes,
}
