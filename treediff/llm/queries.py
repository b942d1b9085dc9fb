"""The queries of this package by name, and SQL for those that it can express."""

from __future__ import annotations

from treediff.llm import alignment, bpe, chat, decontaminate, licences, mixing, pieces, quality, sharding, simhash, substrings, toxicity, trie


def queries() -> dict:
    found = (
        mixing.op1_mixing_scores, licences.op2_licences, chat.op3_chat_format, quality.op4_quality_rules, substrings.op5_substring_dedup,
        bpe.op6_bpe, decontaminate.op7_decontamination, toxicity.op8_toxicity, simhash.op9_simhash, sharding.op10_jump_shards,
        pieces.op11_sentencepiece, trie.op12_prefix_trie, alignment.op13_token_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_licences": licences.SQL, "op3_chat_format": chat.SQL, "op4_quality_rules": quality.SQL, "op5_substring_dedup": substrings.SQL, "op7_decontamination": decontaminate.SQL, "op10_jump_shards": sharding.SQL, "op12_prefix_trie": trie.SQL}
