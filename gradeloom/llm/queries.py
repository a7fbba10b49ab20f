"""Queries of this subpackage and the SQL for the same rows, where there is such SQL."""

from __future__ import annotations

from . import decontaminate, html_text, language_id, line_dedup, lm_scoring, media, mixing, pii, sharding, simhash, spelling, toxicity, word_runs

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_media_columns": media.op2_media_columns,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_language_id": language_id.op5_language_id,
    "op6_mixing": mixing.op6_mixing,
    "op7_sharding": sharding.op7_sharding,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash_dedup": simhash.op10_simhash_dedup,
    "op11_pii": pii.op11_pii,
    "op12_periodic_runs": word_runs.op12_periodic_runs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "llm_proximity_matches": decontaminate.llm_proximity_matches,
}

ORACLE = line_dedup.ORACLE | decontaminate.ORACLE | mixing.ORACLE | pii.ORACLE
