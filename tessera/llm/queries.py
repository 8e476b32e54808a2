"""The queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from tessera.llm import decontaminate, html_extract, license_scan, ngram_join, packing, pii, quality_rules, token_counts, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_packing": packing.op4_packing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_pii": pii.op9_pii,
    "op10_html_extraction": html_extract.op10_html_extraction,
}
ORACLE_SQL = {
    "op1_url_filters": url_filters.SQL,
    "op7_quality_rules": quality_rules.SQL,
}
