"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from farsight.llm import collocations, divergence, fingerprint, html, jaccard, language, mixing, ordered_packing, packing, quality, substring, token_counts, toxicity

QUERIES = {
    "op1_packing": packing.query,
    "op2_toxicity": toxicity.query,
    "op3_quality": quality.query,
    "op4_fingerprint": fingerprint.query,
    "op5_substring": substring.query,
    "op6_html": html.query,
    "op7_language": language.query,
    "op8_mixing": mixing.query,
    "op9_jaccard": jaccard.query,
    "op10_token_counts": token_counts.query,
    "op11_collocations": collocations.query,
    "op12_divergence": divergence.query,
    "op13_ordered_packing": ordered_packing.query,
}
ORACLES = {"op5_substring": substring.ORACLE, "op9_jaccard": jaccard.ORACLE, "op11_collocations": collocations.ORACLE, "op12_divergence": divergence.ORACLE}
