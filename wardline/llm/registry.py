"""The opN_ queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import alignment, chat, exact_dedup, filter_audit, lm_scoring, mixing, near_dedup, packing, pii, sharding, substring_dedup, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1,
        "op2_near_dedup": near_dedup.op2,
        "op3_pii": pii.op3,
        "op4_toxicity": toxicity.op4,
        "op5_exact_dedup": exact_dedup.op5,
        "op6_top_k": topk.op6,
        "op7_packing": packing.op7,
        "op8_lm_scoring": lm_scoring.op8,
        "op9_substring_dedup": substring_dedup.op9,
        "op10_sharding": sharding.op10,
        "op11_chat_format": chat.op11,
        "op12_filter_audit": filter_audit.op12,
        "op13_alignment": alignment.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_near_dedup": near_dedup.OP2_SQL,
        "op3_pii": pii.OP3_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op6_top_k": topk.OP6_SQL,
        "op9_substring_dedup": substring_dedup.OP9_SQL,
        "op10_sharding": sharding.OP10_SQL,
        "op11_chat_format": chat.OP11_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
    }
