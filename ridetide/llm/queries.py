"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridetide.llm import (
    classlm,
    conversations,
    flatgraph,
    language,
    linededup,
    minhash,
    mixing,
    onebit,
    packing,
    quality,
    repeats,
    sharding,
    spelling,
)
from ridetide.llm.oracle import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_embedding_near_dedup": flatgraph.op3_embedding_near_dedup,
    "op4_class_lm": classlm.op4_class_lm,
    "op5_language_id": language.op5_language_id,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_sharding": sharding.op7_sharding,
    "op8_substring_dedup": repeats.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_onebit_ann": onebit.op10_onebit_ann,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_line_dedup": linededup.op13_line_dedup,
}

__all__ = ["ORACLE", "QUERIES"]
