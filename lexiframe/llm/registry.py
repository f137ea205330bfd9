"""Queries and oracle SQL of the operators for training corpora."""

from __future__ import annotations

from . import ann, chaining, decontam, mixing, near_dedup, pii, quality, secrets, suffix_dedup, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_substrings": suffix_dedup.op2_substrings,
    "op3_quality": quality.op3_quality,
    "op4_ann": ann.op4_ann,
    "op5_pii": pii.op5_pii,
    "op6_minhash": near_dedup.op6_minhash,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secrets": secrets.op9_secrets,
    "op10_passages": chaining.op10_passages,
}
ORACLES = {"op1_mixing": mixing.OP1_SQL, "op6_minhash": near_dedup.OP6_SQL, "op7_decontaminate": decontam.OP7_SQL}
