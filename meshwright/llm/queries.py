"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, block_dedup, html_extract, mixing, ngram_join, packing, prefix_trie, quality, secret_scan, suffix_dedup, token_counts, tokenfile, topk


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_html_extraction": html_extract.op2_html_extraction,
        "op3_packing": packing.op3_packing,
        "op4_token_files": tokenfile.op4_token_files,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_block_dedup": block_dedup.op6_block_dedup,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_exact_topk": topk.op9_exact_topk,
        "op10_mixing": mixing.op10_mixing,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_block_dedup": block_dedup.OP6_SQL,
        "op8_quality_rules": quality.OP8_SQL,
        "op9_exact_topk": topk.OP9_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
    }
