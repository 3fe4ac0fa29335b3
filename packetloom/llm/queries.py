"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from packetloom.llm import exact, fim, jaccard, langid, lm, merkle, mixing, pieces, pii, quality, secret_scan, urls, vectors

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_url_filter": urls.op2_url_filter,
    "op3_pii_surrogates": pii.op3_pii_surrogates,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_mixing_sources": mixing.op7_mixing_sources,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_embedding_near_dedup": vectors.op10_embedding_near_dedup,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_lm_scores": lm.op12_lm_scores,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op5_exact_dedup": exact.OP5_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
