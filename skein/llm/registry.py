"""The queries of this subpackage and, where SQL can say them, the same in DuckDB's SQL."""

from __future__ import annotations

from skein.llm import decontaminate, exact_dedup, html_text, language, near_dup, pieces, preference, quality, secrets, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_secrets": secrets.op2_secrets,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_preference": preference.op4_preference,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_language": language.op9_language,
    "op10_html": html_text.op10_html,
}
ORACLES = {"op2_secrets": secrets.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op4_preference": preference.ORACLE}
