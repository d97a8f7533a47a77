"""Queries of this subpackage and the SQL that some can be compared with."""

from __future__ import annotations

from volscreen.llm import bpe, html, jaccard, lines, mixing, search, sharding, substrings, toxicity

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_ann": search.op2_ann,
    "op3_sharding": sharding.op3_sharding,
    "op4_top_k": search.op4_top_k,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_bpe": bpe.op7_bpe,
    "op8_html": html.op8_html,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op1_line_dedup": lines.OP1_SQL,
    "op4_top_k": search.OP4_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op6_jaccard": jaccard.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
