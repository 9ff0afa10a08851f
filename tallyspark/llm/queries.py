"""The registered queries of this subpackage and, where SQL can express them, their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import (decontam, fingerprints, jaccard, packing, prefixes, quality, search, secrets, sharding,
                            substring, suffix, tokens, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_sharding": sharding.op2_sharding,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_suffix_array_dedup": suffix.op9_suffix_array_dedup,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_prefix_trie": prefixes.op11_prefix_trie,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_ranked_search": search.op13_ranked_search,
}

ORACLE: dict[str, str] = {"op11_prefix_trie": prefixes.ORACLE, "op13_ranked_search": search.ORACLE}
