"""The ten operators' queries, the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.best_fit_packing import op4_best_fit_packing
from tidemark.llm.chat_formatting import OP1_SQL, op1_chat_formatting
from tidemark.llm.media_columns import op3_media_columns
from tidemark.llm.minhash_dedup import OP5_SQL, op5_minhash_dedup
from tidemark.llm.personal_data import op6_personal_data
from tidemark.llm.quality_rules import op7_quality_rules
from tidemark.llm.sentence_pieces import op2_sentence_pieces
from tidemark.llm.token_counts import op8_token_counts
from tidemark.llm.toxicity import op10_toxicity
from tidemark.llm.url_filters import FIXTURE_SQL, OP9_SQL, fixture_host_reputation, op9_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_sentence_pieces": op2_sentence_pieces,
        "op3_media_columns": op3_media_columns,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_personal_data": op6_personal_data,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_counts": op8_token_counts,
        "op9_url_filters": op9_url_filters,
        "op10_toxicity": op10_toxicity,
        "fixture_host_reputation": fixture_host_reputation,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op5_minhash_dedup": OP5_SQL, "op9_url_filters": OP9_SQL, "fixture_host_reputation": FIXTURE_SQL}
