"""The registered queries of the training-data operators."""

from __future__ import annotations

from . import licenses, near_vectors, ngram_join, oracles, packing, quality, repair, repeats, secrets, spelling, suffixes, tokens, top_k, warc

QUERIES = {
    "op1_quality_classifier": quality.op1,
    "op2_embedding_near_dedup": near_vectors.op2,
    "op3_license_scan": licenses.op3,
    "op4_ngram_jaccard": ngram_join.op4,
    "op5_bpe_roundtrip": tokens.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_substring_dedup": repeats.op7,
    "op8_warc_roundtrip": warc.op8,
    "op9_exact_top_k": top_k.op9,
    "op10_secret_scan": secrets.op10,
    "op11_conversation_repair": repair.op11,
    "op12_suffix_dedup": suffixes.op12,
    "op13_spelling_variants": spelling.op13,
}

ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": oracles.NEAR_VECTORS,
    "op4_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_warc_roundtrip": oracles.WARC,
    "op9_exact_top_k": oracles.TOP_K,
    "op11_conversation_repair": oracles.REPAIR,
    "op12_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op13_spelling_variants": oracles.SPELLING,
}
