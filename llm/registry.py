"""The queries of the numbered operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from llm import decontamination, divergence, html_extract, jaccard, language_model, packing, pii, pivots, quality, secrets, substrings, toxicity, whitening

QUERIES = {
    f.__name__: f
    for f in (
        pivots.op1_embedding_near_dedup, pii.op2_pii, toxicity.op3_toxicity, secrets.op4_secret_scan, packing.op5_best_fit_packing, quality.op6_quality,
        jaccard.op7_ngram_jaccard_join, language_model.op8_lm_scoring, html_extract.op9_html_extraction, decontamination.op10_benchmark_decontamination,
        substrings.op11_substring_dedup, divergence.op12_source_divergence, whitening.op13_embedding_whitening,
    )
}
ORACLE_SQL = {
    "op1_embedding_near_dedup": pivots.ORACLE_OP1, "op7_ngram_jaccard_join": jaccard.ORACLE_OP7, "op8_lm_scoring": language_model.ORACLE_OP8, "op10_benchmark_decontamination": decontamination.ORACLE_OP10,
    "op11_substring_dedup": substrings.ORACLE_OP11, "op12_source_divergence": divergence.ORACLE_OP12,
}
