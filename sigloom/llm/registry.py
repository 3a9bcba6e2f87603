"""Queries of the training-data operators and the oracles of those that SQL can express."""

from __future__ import annotations

from . import chat, conversation_repair, decontaminate, embedding_dedup, fixity, html_text, language_id, lexical_search, minhash_dedup, mixing, suffix_dedup, toxicity, vector_search


def queries() -> dict:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_mixing": mixing.op2_mixing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_chat": chat.op6_chat,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_language_id": language_id.op8_language_id,
        "op9_fixity": fixity.op9_fixity,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_vector_search": vector_search.op12_vector_search,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracles() -> dict[str, str]:
    return {
        "op2_mixing": mixing.oracle_sql(),
        "op4_minhash_dedup": minhash_dedup.ORACLE_SQL,
        "op5_decontamination": decontaminate.ORACLE_SQL,
        "op9_fixity": fixity.ORACLE_SQL,
        "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op11_lexical_search": lexical_search.ORACLE_SQL,
        "op12_vector_search": vector_search.ORACLE_SQL,
        "op13_conversation_repair": conversation_repair.ORACLE_SQL,
    }
