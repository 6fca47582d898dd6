"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import dialogues, exact_dedup, html, mixing, negatives, ngrams, passages, pieces, pii, quality, simhash, topk, toxicity

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_passages": passages.op2_passages,
    "op3_simhash": simhash.op3_simhash,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_pii": pii.op5_pii,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_html": html.op8_html,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
    "op11_negatives": negatives.op11_negatives,
    "op12_ngrams": ngrams.op12_ngrams,
    "op13_dialogues": dialogues.op13_dialogues,
}
ORACLES = {
    "op1_topk": topk.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_negatives": negatives.ORACLE_SQL,
    "op13_dialogues": dialogues.ORACLE_SQL,
}
