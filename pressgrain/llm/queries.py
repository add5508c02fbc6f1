"""Registered queries of the corpus operators and the DuckDB SQL some are checked against."""

from __future__ import annotations

from pressgrain.llm import decontaminate, html_text, lang_id, line_chunks, lm_score, near_text, near_vectors, packing, prefix_trie, repeats, spelling, token_file, warc

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_near_text": near_text.op3_near_text,
    "op4_language": lang_id.op4_language,
    "op5_line_chunks": line_chunks.op5_line_chunks,
    "op6_pack_sequences": packing.op6_pack_sequences,
    "op7_contamination": decontaminate.op7_contamination,
    "op8_token_files": token_file.op8_token_files,
    "op9_near_vectors": near_vectors.op9_near_vectors,
    "op10_warc": warc.op10_warc,
    "op11_repeats": repeats.op11_repeats,
    "op12_spelling": spelling.op12_spelling,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op10_warc": warc.OP10_SQL,
}
