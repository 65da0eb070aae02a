"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

import functools

from flowlens.llm import (chat, fim, imi, langid, lines, lm, neardup, packing, spm, syncmers, tokenscan, toxicity, trie)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_minhash_near_dedup": neardup.query,
    "op3_language_id": langid.query,
    "op4_lm_scoring": lm.query,
    "op5_document_fingerprints": syncmers.query,
    "op6_chat_formatting": chat.query,
    "op7_token_counts": tokenscan.query,
    "op8_embedding_near_dedup": imi.query,
    "op9_sentencepiece": spm.query,
    "op10_best_fit_packing": packing.query,
    "op11_fill_in_middle": fim.query,
    "op12_line_dedup": lines.query,
    "op13_conversation_trie": trie.query,
}


def _utc(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def queries() -> dict:
    return {name: _utc(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict:
    return {"op6_chat_formatting": chat.ORACLE, "op8_embedding_near_dedup": imi.ORACLE, "op11_fill_in_middle": fim.ORACLE,
            "op12_line_dedup": lines.ORACLE, "op13_conversation_trie": trie.ORACLE}
