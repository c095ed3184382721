"""Queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from . import best_fit, chat_format, decontaminate, exact_dedup, fill_in_middle, html_extract, jaccard_join, packing, pii, pitman_yor, prefix_trie, quality, sharding

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_sharding": sharding.op2_sharding,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_packing": packing.op4_packing,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_language_model": pitman_yor.op10_language_model,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_best_fit": best_fit.op12_best_fit,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op3_chat_format": chat_format.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
