"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import oracles
from . import queries_dedup as dedup
from . import queries_other as other
from . import queries_text as text


def queries() -> dict:
    return {
        "op1_ngram_jaccard": dedup.op1_ngram_jaccard,
        "op2_token_counts": text.op2_token_counts,
        "op3_byte_bpe": text.op3_byte_bpe,
        "op4_quality_rules": other.op4_quality_rules,
        "op5_substring_dedup": dedup.op5_substring_dedup,
        "op6_warc": other.op6_warc,
        "op7_mix": other.op7_mix,
        "op8_toxicity": other.op8_toxicity,
        "op9_exact_topk": other.op9_exact_topk,
        "op10_chat_format": other.op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
