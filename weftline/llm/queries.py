"""Registered queries of the subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from weftline.llm import html, jaccard, lm, media, mixing, packing, pii, shallot, spelling, substrings, tokencounts, topk, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op8_jaccard": jaccard.op8_jaccard,
    "op3_html": html.op3_html,
    "op4_topk": topk.op4_topk,
    "op5_toxicity": toxicity.op5_toxicity,
    "op2_media": media.op2_media,
    "op10_substrings": substrings.op10_substrings,
    "op7_lm": lm.op7_lm,
    "op1_pii": pii.op1_pii,
    "op6_packing": packing.op6_packing,
    "op9_mixing": mixing.op9_mixing,
    "op11_tokens": tokencounts.op11_tokens,
    "op12_shallot": shallot.op12_shallot,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op4_topk": topk.ORACLE_SQL,
    "op8_jaccard": jaccard.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op12_shallot": shallot.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
