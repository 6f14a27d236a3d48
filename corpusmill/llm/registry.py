"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import (
    bpe, chat, fmindex, linededup, negatives, neighbours, pseudonyms, quality, runs, sharding, simhash, templates, toxicity,
)

QUERIES: dict = {
    "op1_simhash": simhash.query,
    "op2_toxicity": toxicity.query,
    "op3_pseudonyms": pseudonyms.query,
    "op4_quality": quality.query,
    "op5_bpe": bpe.query,
    "op6_neighbours": neighbours.query,
    "op7_chat": chat.query,
    "op8_sharding": sharding.query,
    "op9_decontamination": fmindex.query,
    "op10_line_dedup": linededup.query,
    "op11_hard_negatives": negatives.query,
    "op12_periodic_runs": runs.query,
    "op13_html_text": templates.query,
}
ORACLE: dict = {
    "op7_chat": chat.ORACLE,
    "op9_decontamination": fmindex.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op13_html_text": templates.ORACLE,
}
