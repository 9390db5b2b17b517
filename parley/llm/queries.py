"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import embedding_dedup, exact_dedup, html_extract, language_id, line_dedup, packing, piece_tokens, prefix_trie, simhash, token_counts, token_files, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_toxicity": toxicity.query,
        "op3_token_counts": token_counts.query,
        "op4_best_fit_packing": packing.query,
        "op5_embedding_dedup": embedding_dedup.query,
        "op6_html_extraction": html_extract.query,
        "op7_language_id": language_id.query,
        "op8_piece_tokens": piece_tokens.query,
        "op9_token_files": token_files.query,
        "op10_simhash": simhash.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_embedding_whitening": whitening.query,
        "op13_line_dedup": line_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op11_prefix_trie": prefix_trie.SQL, "op13_line_dedup": line_dedup.SQL}
