"""The corpus operators' queries and their SQL, for the driver contract."""

from __future__ import annotations

from . import classifier, exact_dedup, lm, packing, pieces, pii, rules, secrets, sharding, simhash

QUERIES = {
    "op1_quality_classifier": classifier.query,
    "op2_sharding": sharding.query,
    "op3_quality_rules": rules.query,
    "op4_sentencepiece": pieces.query,
    "op5_packing": packing.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_lm_scoring": lm.query,
    "op8_secret_scan": secrets.query,
    "op9_simhash": simhash.query,
    "op10_pii": pii.query,
}
ORACLES = {
    "op6_exact_dedup": exact_dedup.ORACLE,
}
