"""Queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import op01_mixing, op02_warc, op03_chat, op04_similar, op05_pieces, op06_quality, op07_secrets, op08_flac, op09_private, op10_tokens, op11_decontaminate, op12_align, op13_ranked

QUERIES = {
    "op1_mixing": op01_mixing.op1_mixing,
    "op2_warc": op02_warc.op2_warc,
    "op3_chat": op03_chat.op3_chat,
    "op4_similar": op04_similar.op4_similar,
    "op5_pieces": op05_pieces.op5_pieces,
    "op6_quality": op06_quality.op6_quality,
    "op7_secrets": op07_secrets.op7_secrets,
    "op8_flac": op08_flac.op8_flac,
    "op9_private": op09_private.op9_private,
    "op10_tokens": op10_tokens.op10_tokens,
    "op11_decontaminate": op11_decontaminate.op11_decontaminate,
    "op12_align": op12_align.op12_align,
    "op13_ranked": op13_ranked.op13_ranked,
}

SQL = {
    "op1_mixing": op01_mixing.OP1_SQL,
    "op2_warc": op02_warc.OP2_SQL,
    "op3_chat": op03_chat.OP3_SQL,
    "op4_similar": op04_similar.OP4_SQL,
    "op11_decontaminate": op11_decontaminate.OP11_SQL,
    "op13_ranked": op13_ranked.OP13_SQL,
}
