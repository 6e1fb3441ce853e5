"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from lectern.llm import byte_bpe, exact_dedup, fingerprints, language_id, lm_scoring, ngram_join, packing, quality_rules, ranked_retrieval, resampling, suffix_dedup, toxicity, url_filters

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_resampling": resampling.op11_resampling,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_ranked_search": ranked_retrieval.op13_ranked_search,
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op9_url_filters": url_filters.OP9_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_resampling": resampling.OP11_SQL,
    "op13_ranked_search": ranked_retrieval.OP13_SQL,
}
