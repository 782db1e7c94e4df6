"""The queries of this subpackage, and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import ann, decontaminate, linededup, mixing, neardup, pagetext, phrases, pii, quality, secrets, spelling, toxicity, urlfilter

QUERIES = {
    "op1_nearest_vectors": ann.op1_nearest_vectors,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_benchmark_leaks": decontaminate.op3_benchmark_leaks,
    "op4_personal_data": pii.op4_personal_data,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_url_rules": urlfilter.op6_url_rules,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_quality": quality.op8_quality,
    "op9_line_runs": linededup.op9_line_runs,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_main_text": pagetext.op11_main_text,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL = {"op6_url_rules": urlfilter.ORACLE_SQL, "op12_spelling_variants": spelling.ORACLE_SQL, "op13_phrases": phrases.ORACLE_SQL}
