"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from lectern.llm import codebooks, conversations, jaccard_join, licenses, mixing, packing, pii, quality, repeats, token_counts, topk, toxicity, url_filter

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_topk": topk.op7_topk,
    "op8_packing": packing.op8_packing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_vector_codes": codebooks.op11_vector_codes,
    "op12_repeats": repeats.op12_repeats,
    "op13_conversations": conversations.op13_conversations,
}
ORACLES = {
    "op3_mixing": mixing.SQL,
    "op4_quality_rules": quality.SQL,
    "op7_topk": topk.SQL,
    "op10_url_filters": url_filter.SQL,
    "op11_vector_codes": codebooks.SQL,
    "op12_repeats": repeats.SQL,
    "op13_conversations": conversations.SQL,
}
