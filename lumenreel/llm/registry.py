"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenreel.llm import chat, huffman, kneserney, mixing, packing, partenum, pigeonhole, pii, quality, resampling, spelling, suffixes, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bootstrapped_pii": pii.op1_bootstrapped_pii,
    "op2_subspace_pigeonhole": pigeonhole.op2_subspace_pigeonhole,
    "op3_random_indexing_quality": quality.op3_random_indexing_quality,
    "op4_kneser_ney": kneserney.op4_kneser_ney,
    "op5_huffman_token_files": huffman.op5_huffman_token_files,
    "op6_configuration_packing": packing.op6_configuration_packing,
    "op7_histogram_top_k": topk.op7_histogram_top_k,
    "op8_hypergeometric_mix": mixing.op8_hypergeometric_mix,
    "op9_partenum_jaccard": partenum.op9_partenum_jaccard,
    "op10_suffix_array_dedup": suffixes.op10_suffix_array_dedup,
    "op11_anagram_variants": spelling.op11_anagram_variants,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_prefix_tree_chat": chat.op13_prefix_tree_chat,
}

ORACLE_SQL: dict[str, str] = {
    "op2_subspace_pigeonhole": pigeonhole.ORACLE,
    "op7_histogram_top_k": topk.ORACLE,
    "op8_hypergeometric_mix": mixing.ORACLE,
    "op9_partenum_jaccard": partenum.ORACLE,
    "op11_anagram_variants": spelling.ORACLE,
    "op12_importance_resampling": resampling.ORACLE,
}
