"""The queries of this subpackage and the DuckDB statements for those that SQL can express."""

from __future__ import annotations

from docloom.llm import bpe, centroids, conversation_repair, exact_dedup, jaccard_join, language_id, lm_score, mixing, pii, quality, token_files, toxicity, url_filter

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_language_id": language_id.op7_language_id,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_pii": pii.op10_pii,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_delta_lloyd": centroids.op12_delta_lloyd,
    "op13_token_files": token_files.op13_token_files,
}
ORACLES = {"op2_url_filter": url_filter.OP2_SQL, "op3_exact_dedup": exact_dedup.OP3_SQL, "op11_conversation_repair": conversation_repair.OP11_SQL, "op12_delta_lloyd": centroids.OP12_SQL}
