"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from palimpsest.llm import counts, fingerprints, language, lmscore, neardup, packing, pieces, toxicity, trie, vectors, warc, whitening

QUERIES = {
    "op1_sampled_pieces": pieces.op1_sampled_pieces,
    "op2_language_id": language.op2_language_id,
    "op3_edited_token_counts": counts.op3_edited_token_counts,
    "op4_cross_entropy_difference": lmscore.op4_cross_entropy_difference,
    "op5_packing": packing.op5_packing,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_exact_top_k": vectors.op7_exact_top_k,
    "op8_embedding_near_duplicates": vectors.op8_embedding_near_duplicates,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
    "op11_conversation_trie": trie.op11_conversation_trie,
    "op12_document_fingerprints": fingerprints.op12_document_fingerprints,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op4_cross_entropy_difference": lmscore.OP4_SQL,
    "op7_exact_top_k": vectors.OP7_SQL,
    "op8_embedding_near_duplicates": vectors.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_conversation_trie": trie.OP11_SQL,
}
