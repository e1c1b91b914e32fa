"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from bucketwise.llm import (
    byte_pairs,
    fingerprints,
    hard_negatives,
    language_id,
    media,
    mixing,
    pii,
    sentence_pieces,
    simhash,
    suffix_dedup,
    token_files,
    url_filter,
    vector_codes,
)

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_token_files": token_files.op2_token_files,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_sentence_pieces": sentence_pieces.op4_sentence_pieces,
    "op5_simhash_near_duplicates": simhash.op5_simhash_near_duplicates,
    "op6_media_columns": media.op6_media_columns,
    "op7_language_id": language_id.op7_language_id,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
    "op10_filter_urls": url_filter.op10_filter_urls,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_byte_pairs": byte_pairs.op12_byte_pairs,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op8_mix_sources": mixing.OP8_SQL,
    "op10_filter_urls": url_filter.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
