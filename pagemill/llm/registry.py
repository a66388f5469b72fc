"""Queries of the training-data operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from . import automaton, bpe, chat, exact, language, lines, merkle, mixing, quality, repair, rindex, simhash, syncmers

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_substring_dedup": automaton.op2_substring_dedup,
    "op3_suffix_array_dedup": rindex.op3_suffix_array_dedup,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_language_id": language.op7_language_id,
    "op8_chat_format": chat.op8_chat_format,
    "op9_fingerprints": syncmers.op9_fingerprints,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_quality_rules": quality.op13_quality_rules,
}

ORACLE = {
    "op2_substring_dedup": automaton.OP2_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op5_exact_dedup": exact.OP5_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_structure_repair": repair.OP12_SQL,
    "op13_quality_rules": quality.OP13_SQL,
}
