"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from inkspark.llm import decontaminate, html_text, importance, near_dedup, packing, phrases, quality_rules, sharding, substring_dedup, token_counts, toxicity, url_filter, vector_dedup

QUERIES = {
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "llm_base_statistics": quality_rules.llm_base_statistics,
    "op5_extendible_sharding": sharding.op5_extendible_sharding,
    "llm_small_shards": sharding.llm_small_shards,
    "op7_hyperminhash_near_dedup": near_dedup.op7_hyperminhash_near_dedup,
    "op8_transducer_token_counts": token_counts.op8_transducer_token_counts,
    "op4_counterfactual_toxicity": toxicity.op4_counterfactual_toxicity,
    "op9_lstm_html_text": html_text.op9_lstm_html_text,
    "op1_chained_substring_dedup": substring_dedup.op1_chained_substring_dedup,
    "op3_latent_decontamination": decontaminate.op3_latent_decontamination,
    "op6_variable_best_fit": packing.op6_variable_best_fit,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_pcy_collocations": phrases.op11_pcy_collocations,
    "op12_flat_graph_near_vectors": vector_dedup.op12_flat_graph_near_vectors,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
ORACLE = {
    "llm_base_statistics": quality_rules.BASE_SQL,
    "op5_extendible_sharding": sharding.ORACLE_SQL,
    "llm_small_shards": sharding.SMALL_ORACLE_SQL,
    "op7_hyperminhash_near_dedup": near_dedup.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op11_pcy_collocations": phrases.ORACLE_SQL,
    "op12_flat_graph_near_vectors": vector_dedup.ORACLE_SQL,
    "op13_importance_resampling": importance.ORACLE_SQL,
}
