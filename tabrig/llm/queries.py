"""Registered queries of the subpackage and their DuckDB SQL."""

from . import (chat, langid, linededup, merkle, mixing, neardup, pieces, rules, secrets, tokenfiles, topk, toxicity,
               variants)

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_secrets": secrets.op2,
    "op3_pieces": pieces.op3,
    "op4_rules": rules.op4,
    "op5_topk": topk.op5,
    "op6_chat": chat.op6,
    "op7_token_files": tokenfiles.op7,
    "op8_neardup": neardup.op8,
    "op9_line_dedup": linededup.op9,
    "op9_line_dedup_whole": linededup.op9_whole,
    "op10_mixing": mixing.op10,
    "op11_variants": variants.op11,
    "op12_manifest": merkle.op12,
    "op13_language": langid.op13,
}

ORACLES = {
    "op5_topk": topk.OP5_SQL,
    "op6_chat": chat.OP6_SQL,
    "op8_neardup": neardup.OP8_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_variants": variants.OP11_SQL,
    "op12_manifest": merkle.OP12_SQL,
}
