"""The registered queries of this package and their SQL, by name."""

from __future__ import annotations

from . import codes, langid, lm, mixing, near, pieces, quality, secrets, tokens, urls

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_exact_top_k": codes.op6_exact_top_k,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_minhash_near_dedup": near.op8_minhash_near_dedup,
    "op9_url_filters": urls.op9_url_filters,
    "op10_language_id": langid.op10_language_id,
}

#: The others can't be said in SQL and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_exact_top_k": codes.ORACLE,
}
