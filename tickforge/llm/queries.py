"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tickforge.llm import chat, decontaminate, hmm, html, jaccard, kneser_ney, packing, quality, substring, toxicity


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_html_extraction": html.op2_html_extraction,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_quality_classifier": kneser_ney.op4_quality_classifier,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_hmm_scoring": hmm.op10_hmm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {**quality.ORACLE, **substring.ORACLE, **jaccard.ORACLE}
