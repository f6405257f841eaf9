"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pipewright.llm import class_lm, fingerprint, html_extract, manifest, near_dedup, packing, piece_codec, quality, sharding, spelling, suffix_dedup, topk_search, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_sharding": sharding.op2_sharding,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_quality": quality.op4_quality,
    "op5_packing": packing.op5_packing,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_piece_codec": piece_codec.op9_piece_codec,
    "op10_topk_search": topk_search.op10_topk_search,
    "op11_class_lm": class_lm.op11_class_lm,
    "op12_manifest": manifest.op12_manifest,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_sharding": sharding.OP2_SQL,
    "op3_suffix_dedup": suffix_dedup.OP3_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op8_html_extract": html_extract.OP8_SQL,
    "op10_topk_search": topk_search.OP10_SQL,
    "op12_manifest": manifest.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
