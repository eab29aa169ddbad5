"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bradley_terry, chat_format, conversation_repair, language_id, line_dedup, mixing, ngram_join, repair_tokens, sentencepiece_codec, sharding, telephony, vector_codes, weak_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bradley_terry": bradley_terry.op1_bradley_terry,
        "op2_mixing": mixing.op2_mixing,
        "op3_weak_rules": weak_rules.op3_weak_rules,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_telephony": telephony.op5_telephony,
        "op6_sharding": sharding.op6_sharding,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
        "op9_language_id": language_id.op9_language_id,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_repair_tokens": repair_tokens.op13_repair_tokens,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.OP2_SQL,
        "op4_chat_format": chat_format.OP4_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op10_ngram_join": ngram_join.OP10_SQL,
        "op11_conversation_repair": conversation_repair.OP11_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
    }
