"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import language, neardup, packing, shared, toxicity
from tidepanel.storage import materialise, shrink_batches, small_batches

# Near duplicates share 80 per cent of their shingles of five words.
NEAR = neardup.Shape(width=5, percent=80)
TOKENIZER = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the others go.

    Gone are texts that are null or without a letter, and those of which no
    language has a probability of a half.
    """
    shrink_batches(spark)
    return language.keep(docs, language.fit(docs, language.trainable(docs)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text does not score as toxic.

    Texts that are null, empty or without a learnt term score as such texts do in the
    labelled rows, and stay; repeated rows are judged alike; without labels of both
    kinds all stay.
    """
    shrink_batches(spark)
    return toxicity.keep(docs, toxicity.fit(docs, shared.table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Documents without a word, with a null text or without an id all stay; of rows that
    repeat an id one stays.
    """
    shrink_batches(spark)
    return neardup.keep_first(docs, NEAR)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of packed sequences, one row per piece.

    A null or empty text is one piece, its end-of-text id; repeated rows are packed each;
    equal lengths are placed in row order.
    """
    shrink_batches(spark)
    packed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


# Rows hold whole texts, and who calls a stage writes its rows after it has returned. So each stage leaves the
# session with small batches to Python; ``run`` gives the settings back.
STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

# Learnt models decide the rows, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
