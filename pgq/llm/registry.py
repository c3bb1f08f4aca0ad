"""Queries of this subpackage, and SQL for those that SQL can express."""

from . import html_main, lm, mixing, neighbours, packing, quality, simhash, suffix_dedup, syncmers, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_syncmer_fingerprints": syncmers.op2,
    "op3_cross_polytope": neighbours.op3,
    "op4_toxicity": toxicity.op4,
    "op5_html_main_text": html_main.op5,
    "op6_quality": quality.op6,
    "op7_simhash": simhash.op7,
    "op8_mixing": mixing.op8,
    "op9_packing": packing.op9,
    "op10_lm_scores": lm.op10,
}

ORACLE = {"op8_mixing": mixing.ORACLE}
