"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bag_minhash, chat, exact_dedup, filter_audit, line_crf, mtree, packing, pieces, secrets, suffix_dedup, token_files, url_filter, whitening

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_mtree_top_k": mtree.op2_mtree_top_k,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_ids": token_files.op4_token_ids,
    "op5_quality_crf": line_crf.op5_quality_crf,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_near_dedup": bag_minhash.op7_near_dedup,
    "op8_url_reputation": url_filter.op8_url_reputation,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_whitening": whitening.op11_whitening,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_chat_format": chat.op13_chat_format,
}

ORACLE_SQL = {
    "op2_mtree_top_k": mtree.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op7_near_dedup": bag_minhash.ORACLE,
    "op8_url_reputation": url_filter.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_chat_format": chat.ORACLE,
}
