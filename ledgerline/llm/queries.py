"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, decontamination, html_extract, license_scan, lm_score, mixing, near_dedup, packing, quality, suffix_dedup, token_counts, token_output, turn_repair

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_token_output": token_output.op6_token_output,
    "op7_mixing": mixing.op7_mixing,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_packing": packing.op12_packing,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}
ORACLE: dict[str, str] = {
    "op7_mixing": mixing.ORACLE,
}
