"""Queries of the training-data operators and the SQL that must give the same rows."""

from __future__ import annotations

from wayfare.llm import decontaminate, embedding_dedup, fill_in_middle, html_extract, language_id, minhash, packing, secret_scan, suffix_dedup, token_alignment, token_counts, token_frames, url_filter


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_minhash": minhash.op10_minhash,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_token_frames": token_frames.op13_token_frames,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.OP2_SQL,
        "op3_suffix_dedup": suffix_dedup.OP3_SQL,
        "op5_embedding_dedup": embedding_dedup.OP5_SQL,
        "op7_secret_scan": secret_scan.OP7_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op10_minhash": minhash.OP10_SQL,
        "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    }
