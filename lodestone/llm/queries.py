"""The corpus queries and, where SQL can express one, their SQL."""

from __future__ import annotations

from lodestone.llm import ann, bpe, html, licenses, line_dedup, near_dedup, packing, pii, quality, toxicity

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality_llr": quality.op2_quality_llr,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_pattern_packing": packing.op4_pattern_packing,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_pii_spans": pii.op6_pii_spans,
    "op7_ivf_pq": ann.op7_ivf_pq,
    "op8_line_templates": line_dedup.op8_line_templates,
    "op9_host_suffixes": html.op9_host_suffixes,
    "op10_severity": toxicity.op10_severity,
}
SQL: dict[str, str] = {"op2_quality_llr": quality.SQL}
