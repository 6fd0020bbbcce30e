"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from barspark.llm import decontaminate, html_text, jaccard_join, lexical, license_scan, nearest, packing, pii, prefix_trie, quality, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_html_text": html_text.op4_html_text,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_packing": packing.op6_packing,
    "op7_pii": pii.op7_pii,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_nearest": nearest.op9_nearest,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_lexical": lexical.op11_lexical,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_warc": warc.op13_warc,
}
ORACLES: dict[str, str] = {"op5_decontaminate": decontaminate.ORACLE, "op11_lexical": lexical.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_warc": warc.ORACLE}
