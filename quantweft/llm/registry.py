"""Queries and SQL of the corpus operators, for the entry module."""

from __future__ import annotations

from quantweft.llm import bpe, chat, debruijn, decontamination, divergence, exact_dedup, infill, jaccard_join, quality, secrets, suffixes, token_counts, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": debruijn.op2_substring_dedup,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_quality": quality.op9_quality,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_divergence": divergence.op11_divergence,
    "op12_chat": chat.op12_chat,
    "op13_infill": infill.op13_infill,
}
SQL = {
    "op2_substring_dedup": debruijn.OP2_SQL,
    "op5_secret_scan": secrets.op5_sql(),
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_chat": chat.OP12_SQL,
    "op13_infill": infill.OP13_SQL,
}
