"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, line_dedup, packing, quality_classifier, quality_rules, sanitise, secrets, simhash_dedup, token_files, url_filter

QUERIES = {
    "op1_token_files": token_files.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_secret_scan": secrets.op3,
    "op4_quality_classifier": quality_classifier.op4,
    "op5_pii_sanitise": sanitise.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_url_filter": url_filter.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_simhash_near_dedup": simhash_dedup.op10,
}
ORACLE_SQL = {"op8_line_dedup": line_dedup.OP8_SQL}
