"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

All stages but the last return the columns of ``documents``. Intermediate tables lie in the folder that
``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridetide.llm.common import table, written
from ridetide.llm.language import in_known_language
from ridetide.llm.minhash import without_near_duplicates
from ridetide.llm.mixing import mixed
from ridetide.llm.packing import pack
from ridetide.llm.repeats import without_repeats


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every learned language, go."""
    return in_known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles agree to 0.8 or more, the one of the smallest id stays."""
    return without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of smaller id holds are cut out."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them: not at all, once or twice."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 1024 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None
"""None: SQL cannot express rank-order profiles, tokenizing or packing; tests compare with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
