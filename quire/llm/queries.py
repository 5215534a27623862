"""Queries of this subpackage, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import chat, ctw, decontaminate, language, mixing, secrets, simhash, toxicity, voronoi, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_poisson_mix": mixing.op2_poisson_mix,
        "op3_simhash": simhash.op3_simhash,
        "op4_chat_format": chat.op4_chat_format,
        "op5_context_tree": ctw.op5_context_tree,
        "op6_voronoi_top_k": voronoi.op6_voronoi_top_k,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_language": language.op8_language,
        "op9_warc_archive": warc.op9_warc_archive,
        "op10_secret_scan": secrets.op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.oracle(),
        "op2_poisson_mix": mixing.oracle(),
        "op4_chat_format": chat.oracle(),
        "op6_voronoi_top_k": voronoi.oracle(),
        "op9_warc_archive": warc.oracle(),
    }
