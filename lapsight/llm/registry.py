"""The queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapsight.llm import (
    class_lm,
    language_id,
    lexical_search,
    media,
    near_duplicates,
    piece_sampling,
    quality_rules,
    secret_scan,
    source_mix,
    suffix_dedup,
    token_ledger,
    vector_duplicates,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_source_mix": source_mix.op2_source_mix,
        "op3_piece_sampling": piece_sampling.op3_piece_sampling,
        "op4_token_ledger": token_ledger.op4_token_ledger,
        "op5_media": media.op5_media,
        "op6_near_duplicates": near_duplicates.op6_near_duplicates,
        "op7_language_id": language_id.op7_language_id,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_repeated_strings": suffix_dedup.op9_repeated_strings,
        "op10_class_lm": class_lm.op10_class_lm,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_whitening": whitening.op12_whitening,
        "op13_vector_duplicates": vector_duplicates.op13_vector_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mix": source_mix.OP2_SQL,
        "op8_quality_rules": quality_rules.OP8_SQL,
        "op11_lexical_search": lexical_search.OP11_SQL,
        "op13_vector_duplicates": vector_duplicates.OP13_SQL,
    }
