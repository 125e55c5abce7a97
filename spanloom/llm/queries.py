"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import chat_format, exact_dedup, language_id, mixing, near_dedup, packing, substring_dedup, token_counts, topk, toxicity
from spanloom.llm.common import prepare


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir.rstrip("/"))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        topk.op1_exact_topk,
        chat_format.op2_chat_format,
        packing.op3_packing,
        token_counts.op4_token_counts,
        toxicity.op5_toxicity,
        language_id.op6_language_id,
        near_dedup.op7_near_dedup,
        mixing.op8_mixing,
        exact_dedup.op9_exact_dedup,
        substring_dedup.op10_substring_dedup,
    ]
    return {f.__name__: _ready(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": topk.OP1_SQL, "op2_chat_format": chat_format.OP2_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL}
