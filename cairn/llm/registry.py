"""Queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from cairn.llm import chat, decontamination, fill_middle, language, mixing, near_dedup, phrases, pieces, sstable, suffix_dedup, token_counts, topk, toxicity

_ALL = {
    "op1_decontamination": decontamination,
    "op2_token_shards": sstable,
    "op3_token_counts": token_counts,
    "op4_sentencepiece": pieces,
    "op5_toxicity": toxicity,
    "op6_near_dedup": near_dedup,
    "op7_chat_format": chat,
    "op8_language": language,
    "op9_suffix_dedup": suffix_dedup,
    "op10_topk": topk,
    "op11_mixing": mixing,
    "op12_fill_middle": fill_middle,
    "op13_phrases": phrases,
}


def queries() -> dict:
    return {name: module.query for name, module in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """SQL where it expresses the operator; the others are tested against brute force, libraries or held-out rows."""
    return {name: module.SQL for name, module in _ALL.items() if hasattr(module, "SQL")}
