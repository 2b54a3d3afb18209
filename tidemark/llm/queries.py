"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from . import chat, decontaminate, fillmiddle, mixing, neighbours, periodicruns, pieces, pseudolikelihood, quality, simhash, suffixdedup, tokenstore, urlrules

QUERIES = {
    "op1_tokenstore": tokenstore.query,
    "op2_neighbours": neighbours.query,
    "op3_mixing": mixing.query,
    "op4_url_rules": urlrules.query,
    "op5_pseudolikelihood": pseudolikelihood.query,
    "op6_quality": quality.query,
    "op7_decontaminate": decontaminate.query,
    "op8_chat": chat.query,
    "op9_simhash": simhash.query,
    "op10_suffix_dedup": suffixdedup.query,
    "op11_pieces": pieces.query,
    "op12_fill_middle": fillmiddle.query,
    "op13_periodic_runs": periodicruns.query,
}
SQL = {
    "op3_mixing": mixing.SQL,
    "op4_url_rules": urlrules.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op8_chat": chat.SQL,
    "op10_suffix_dedup": suffixdedup.SQL,
    "op12_fill_middle": fillmiddle.SQL,
    "op13_periodic_runs": periodicruns.SQL,
}
