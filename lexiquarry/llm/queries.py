"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, jaccard, language, sharding, substrings, tokenfiles, topk, toxicity, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_main_text": wrappers.op2_main_text,
    "op3_repeated_bytes": substrings.op3_repeated_bytes,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_rendezvous": sharding.op5_rendezvous,
    "op6_word_bpe": bpe.op6_word_bpe,
    "op7_contained_items": decontaminate.op7_contained_items,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_files": tokenfiles.op9_token_files,
    "op10_language": language.op10_language,
}

ORACLE_SQL: dict[str, str] = {**decontaminate.ORACLE_SQL, **topk.ORACLE_SQL, **jaccard.ORACLE_SQL, **sharding.ORACLE_SQL}
