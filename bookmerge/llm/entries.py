"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookmerge.llm import alignment, chat_windows, decontaminate, jaccard_join, line_dedup, near_vectors, packing, prefix_trie, quality_model, quality_rules, secrets, sql, token_file, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_alignment": alignment.op12_alignment,
        "op13_near_vectors": near_vectors.op13_near_vectors,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_chat_windows": chat_windows.op4_chat_windows,
        "op5_secrets": secrets.op5_secrets,
        "op6_quality_model": quality_model.op6_quality_model,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_packing": packing.op8_packing,
        "op9_token_file": token_file.op9_token_file,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
