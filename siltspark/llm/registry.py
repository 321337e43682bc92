"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from siltspark.llm import chat, decontaminate, langid, lm, neardup, negatives, packing, passages, runs, secrets, topk, toxicity, urls

QUERIES = {
    f.__name__: f
    for f in (
        topk.op1_exact_topk, langid.op2_language_id, toxicity.op3_toxicity, decontaminate.op4_decontamination, packing.op5_packing,
        lm.op6_lm_scores, neardup.op7_near_duplicates, secrets.op8_secrets, passages.op9_repeated_passages, urls.op10_url_verdicts,
        negatives.op11_hard_negatives, runs.op12_periodic_runs, chat.op13_chat_format,
    )
}

ORACLES = {
    "op1_exact_topk": topk.OP1_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op7_near_duplicates": neardup.OP7_SQL,
    "op10_url_verdicts": urls.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op13_chat_format": chat.OP13_SQL,
}
