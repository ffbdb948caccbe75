"""Registered queries of this package and the SQL that states the same."""

from __future__ import annotations

from ticketlens.llm import (
    jaccard, langid, mixing, packing, phrases, pii, pivots, preferences, quality_rules, setsketch, suffixes,
    toxicity, trie,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_shingle_join": jaccard.op2_shingle_join,
    "op2_link_counts": jaccard.op2_link_counts,
    "op3_preference_format": preferences.op3_preference_format,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_curriculum_mixing": mixing.op6_curriculum_mixing,
    "op7_pivot_search": pivots.op7_pivot_search,
    "op8_pii": pii.op8_pii,
    "op9_bin_slack_packing": packing.op9_bin_slack_packing,
    "op10_language_mixture": langid.op10_language_mixture,
    "op11_setsketch_dedup": setsketch.op11_setsketch_dedup,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_son_phrases": phrases.op13_son_phrases,
}

#: op1, op5 and op10 learn from rows, op4, op8 and op9 digest text by rules beyond SQL: tests/llm
#: holds those against brute force, round trips and held-out rows
ORACLE = {
    "op2_shingle_join": jaccard.ORACLE,
    "op2_link_counts": jaccard.COUNTS_ORACLE,
    "op3_preference_format": preferences.ORACLE,
    "op6_curriculum_mixing": mixing.ORACLE,
    "op7_pivot_search": pivots.ORACLE,
    "op11_setsketch_dedup": setsketch.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_son_phrases": phrases.ORACLE,
}
