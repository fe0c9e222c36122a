"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, embedding_dedup, licenses, line_dedup, media, mixing, quality, simhash, tool_calls, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_tool_calls": tool_calls.op4_tool_calls,
    "op5_bpe": bpe.op5_bpe,
    "op6_simhash": simhash.op6_simhash,
    "op7_licenses": licenses.op7_licenses,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_media": media.op10_media,
}

SQL = {
    "op1_embedding_dedup": embedding_dedup.OP1_SQL,
    "op4_tool_calls": tool_calls.OP4_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
}
