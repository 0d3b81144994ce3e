"""The corpus operators' queries over whole tables, and their SQL where SQL can say the same.

All modules are imported with this one, so that whoever guards this import has all of them or none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cdclens.llm import decontaminate, line_dedup, media, mixing, ngram_join, quality, substring_dedup, tokens, toxicity, warc

#: Query -> the module that has its ``query`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_substring_dedup": substring_dedup,
    "op3_toxicity": toxicity,
    "op4_decontaminate": decontaminate,
    "op5_mix_sources": mixing,
    "op6_media_columns": media,
    "op7_warc": warc,
    "op8_token_file": tokens,
    "op9_ngram_jaccard": ngram_join,
    "op10_quality": quality,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in MODULES.items() if hasattr(m, "SQL")}
