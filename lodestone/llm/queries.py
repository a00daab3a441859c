"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.op10_query import op10_mix_sources
from lodestone.llm.op11_query import op11_token_alignment
from lodestone.llm.op12_query import op12_simhash_dedup
from lodestone.llm.op13_query import op13_conversation_repair
from lodestone.llm.op1_query import op1_substring_dedup
from lodestone.llm.op2_query import op2_jaccard_join
from lodestone.llm.op3_query import op3_piece_sampling
from lodestone.llm.op4_query import op4_language_id
from lodestone.llm.op5_query import op5_quality_knn
from lodestone.llm.op6_query import op6_fingerprints
from lodestone.llm.op7_query import op7_url_filter
from lodestone.llm.op8_query import op8_quality_rules
from lodestone.llm.op9_query import op9_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_jaccard_join, op3_piece_sampling, op4_language_id, op5_quality_knn, op6_fingerprints, op7_url_filter, op8_quality_rules, op9_token_files, op10_mix_sources, op11_token_alignment, op12_simhash_dedup, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {}
