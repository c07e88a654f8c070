"""A corpus from raw documents to token images in five stages, each one operator of graphloom.llm on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, nearcopies, simple8b, textcnn
from graphloom.llm._common import cut, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores at or over the threshold of their language."""
    return textcnn.clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reads documents of smaller sources up to twice, those of the largest once; drops none."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token images and returns doc_id, start, n_tokens and ids_crc32 as read back from them."""
    import public_tokenizers

    return simple8b.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_output", token_output)]

#: A trained classifier has no SQL form. Tests hold the stages' operators apart: near copies against all pairs, benchmark hits against a
#: full search, mixing against its SQL, token output against the tokenizer, toxicity by accuracy on held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
