"""The queries of this subpackage and the SQL of those which SQL can express."""

from __future__ import annotations

from keyline.llm import chaining, fingerprints, mixing, near_dedup, packing, pii, quality, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_shared_passages": chaining.op1_shared_passages,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_minhash": near_dedup.op3_minhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_pseudonyms": pii.op6_pseudonyms,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {"op4_mixing": mixing.OP4_SQL}
