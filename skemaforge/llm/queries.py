"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import block_knn, conversation_trie, decontaminate, jaccard_join, katz, language_id, line_dedup, packing, pseudonyms, sentence_pieces, spelling_variants, token_ids, url_filter

QUERIES = {
    "op1_katz": katz.op1_katz,
    "op2_token_files": token_ids.op2_token_files,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_pseudonyms": pseudonyms.op5_pseudonyms,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_language_id": language_id.op9_language_id,
    "op10_block_knn": block_knn.op10_block_knn,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLES = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op10_block_knn": block_knn.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
    "op13_conversation_trie": conversation_trie.SQL,
}
