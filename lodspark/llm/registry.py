"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fim, langid, licenses, lm, media, mixing, neardup, quality, runs, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_chat_format": chat.query,
        "op3_lattice_lm": lm.query,
        "op4_jaccard_join": neardup.query,
        "op5_media_columns": media.query,
        "op6_decontaminate": decontam.query,
        "op7_language_id": langid.query,
        "op8_toxicity": toxicity.query,
        "op9_token_files": tokens.query,
        "op10_mix_sources": mixing.query,
        "op11_periodic_runs": runs.query,
        "op12_fill_in_middle": fim.query,
        "op13_license_scan": licenses.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.ORACLE,
        "op6_decontaminate": decontam.ORACLE,
        "op10_mix_sources": mixing.ORACLE,
        "op12_fill_in_middle": fim.ORACLE,
        "op13_license_scan": licenses.ORACLE,
    }
