"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from ridgeline.llm import bpe, chat, exact_dedup, langid, licenses, mixing, near_dedup, substring, topk, url_filter

QUERIES = {
    "op1_topk": topk.query,
    "op2_mixing": mixing.query,
    "op3_licenses": licenses.query,
    "op4_near_dedup": near_dedup.query,
    "op5_preferences": chat.query,
    "op6_langid": langid.query,
    "op7_bpe": bpe.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_substring": substring.query,
    "op10_url_filter": url_filter.query,
}
SQL = {
    "op1_topk": topk.SQL,
    "op2_mixing": mixing.SQL,
    "op3_licenses": licenses.SQL,
    "op4_near_dedup": near_dedup.SQL,
    "op5_preferences": chat.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
}
