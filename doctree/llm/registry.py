"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, fingerprints, hard_negatives, language, mixing, near_dedup, packing, secrets, sharding, spelling, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_sharding": sharding.op7_sharding,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_packing": packing.op10_packing,
    "op11_spelling": spelling.op11_spelling,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_language": language.op13_language,
}

ORACLES = {
    "op1_secret_scan": secrets.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
