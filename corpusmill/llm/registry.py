"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import alignment, byte_bpe, exact_dedup, html_text, language_id, packing, quality, simhash, target_mix, token_count, vector_codes, vector_search, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_token_counts": token_count.op3_token_counts,
    "op4_html_text": html_text.op4_html_text,
    "op5_simhash": simhash.op5_simhash,
    "op6_warc": warc.op6_warc,
    "op7_top_k": vector_search.op7_top_k,
    "op8_packing": packing.op8_packing,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_quality": quality.op10_quality,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_target_mix": target_mix.op13_target_mix,
}
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op6_warc": warc.SQL, "op7_top_k": vector_search.SQL, "op11_vector_codes": vector_codes.SQL, "op13_target_mix": target_mix.SQL}
