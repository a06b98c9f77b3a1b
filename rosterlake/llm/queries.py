"""The registered queries of this package and the SQL with the same rows, where SQL can say it."""
from __future__ import annotations

from rosterlake.llm import decontaminate, embedding_dedup, hard_negatives, license_scans, lm_scoring, mixing, ngram_join, quality_rules, sharding, source_divergence, toxicity, url_filters, warc

QUERIES = {
    "op1_line_frequency": quality_rules.op1_line_frequency,
    "op2_template_tree": url_filters.op2_template_tree,
    "op3_digest_lookup": license_scans.op3_digest_lookup,
    "op4_prefix_join": decontaminate.op4_prefix_join,
    "op5_jump_hash": sharding.op5_jump_hash,
    "op6_attention": lm_scoring.op6_attention,
    "op7_indexed_archives": warc.op7_indexed_archives,
    "op8_minhash_forest": ngram_join.op8_minhash_forest,
    "op9_field_marginals": toxicity.op9_field_marginals,
    "op10_temperature": mixing.op10_temperature,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_product_quantisation": embedding_dedup.op12_product_quantisation,
    "op13_residue_gemm": hard_negatives.op13_residue_gemm,
}
ORACLES = {
    "op1_line_frequency": quality_rules.SQL,
    "op2_template_tree": url_filters.SQL,
    "op3_digest_lookup": license_scans.SQL,
    "op4_prefix_join": decontaminate.SQL,
    "op5_jump_hash": sharding.SQL,
    "op7_indexed_archives": warc.SQL,
    "op10_temperature": mixing.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op12_product_quantisation": embedding_dedup.SQL,
    "op13_residue_gemm": hard_negatives.SQL,
}
