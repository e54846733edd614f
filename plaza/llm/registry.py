"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from plaza.llm import audit, bands, bytebpe, chat, exact_dedup, jaccard, langid, lattice, packing, pii, repair, urls, variants

QUERIES = {
    "op1_language_profiles": langid,
    "op2_best_fit_packing": packing,
    "op3_exact_dedup": exact_dedup,
    "op4_jaccard_join": jaccard,
    "op5_url_ratio": urls,
    "op6_pii_boosting": pii,
    "op7_repair_tokens": repair,
    "op8_compression_bands": bands,
    "op9_chat_format": chat,
    "op10_piece_lattice": lattice,
    "op11_filter_audit": audit,
    "op12_byte_bpe": bytebpe,
    "op13_spelling_variants": variants,
}


def queries():
    return {name: module.query for name, module in QUERIES.items()}


def oracle_sql():
    return {name: module.ORACLE for name, module in QUERIES.items() if getattr(module, "ORACLE", None)}
