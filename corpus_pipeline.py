"""A training-data pipeline over ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on;
all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import bpe_codec, exact_dedup, language_id, mixing, near_dedup
from quernstone.llm.base import staged_alone

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language."""
    return language_id.keep_known(docs)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, five-word shingles and a similarity of 0.8, the one with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of words taken so that the sources come near their weights."""
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return bpe_codec.encode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", without_exact_copies),
    ("simhash_near_dedup", without_near_copies),
    ("source_mix", mixed_sources),
    ("byte_bpe", encoded),
]

#: Compression sizes, Golay keys and BPE have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written and read again.

    What a stage wrote for itself is deleted when its output is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
