"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, hamming, lmscore, mainhtml, mixing, neardup, packing, phrases, pieces, repetition, substrings, toxicity, urlrules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_toxicity": toxicity.query,
        "op3_repetition_coverage": repetition.query,
        "op4_hamming_topk": hamming.query,
        "op5_main_text": mainhtml.query,
        "op6_cross_entropy_difference": lmscore.query,
        "op7_source_mixing": mixing.query,
        "op8_suffix_array_dedup": substrings.query,
        "op9_near_duplicates": neardup.query,
        "op10_url_rules": urlrules.query,
        "op11_collocations": phrases.query,
        "op12_piece_ids": pieces.query,
        "op13_token_alignment": alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_repetition_coverage": repetition.ORACLE, "op4_hamming_topk": hamming.ORACLE, "op7_source_mixing": mixing.ORACLE, "op9_near_duplicates": neardup.ORACLE, "op10_url_rules": urlrules.ORACLE, "op11_collocations": phrases.ORACLE}
