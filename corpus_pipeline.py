"""A corpus from documents: known languages, one of each group of near copies, no repeated passages, no secrets, packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import langid, packing, secrets, simwide, substring
from tallyloom.llm.runtime import bounded_batches, discard, materialize, scratch


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where docs have it, follows the changed text."""
    length: Column = F.length("text").cast("long")
    return docs.select(*(length.alias(c) if c == "n_chars" else F.col(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null, empty, and without a letter; all stay where no language can be learned. Repeated rows are judged alike, an empty table stays empty."""
    bounded_batches(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: SimHash links within 4 bits and, for the rest, MinHash bands, all verified: five-word shingles, similarity 0.8.

    Null, empty and wordless texts are one group; rows without a doc_id stay; rows that share one go or stay together, and equal ones stay once; an empty table stays empty.
    """
    bounded_batches(spark)
    return simwide.drop_similar(docs, width=5, similarity=0.8, distance=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occur earlier are cut; documents without a word left go.

    Earlier is a smaller doc_id, or the same text before. Null, empty and short texts stay, repeated rows are cut alike, and an empty table stays empty.
    """
    bounded_batches(spark)
    return _with_length(substring.keep_unrepeated(docs), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; null and empty texts and texts without any stay as they are, rows are neither added nor dropped, an empty table stays empty."""
    bounded_batches(spark)
    return _with_length(secrets.mask_secrets(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens. A null or empty text is its end token alone; rows that share a doc_id, or have none, are packed each by itself; an empty table gives no pieces."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Learned languages, components and packing are not expressed in SQL; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written on its way is deleted once its result is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            after = materialize(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
