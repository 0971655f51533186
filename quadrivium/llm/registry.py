"""Registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from . import centroids, chat_rotation, decontamination, exact_dedup, ngram_join, piece_encoding, quality, sharding, signatures, spelling, token_attribution, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_decontamination": decontamination.query,
    "op3_warc": warc.query,
    "op4_token_attribution": token_attribution.query,
    "op5_piece_encoding": piece_encoding.query,
    "op6_quality": quality.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_ngram_join": ngram_join.query,
    "op9_sharding": sharding.query,
    "op10_chat_rotation": chat_rotation.query,
    "op11_centroids": centroids.query,
    "op12_license_signatures": signatures.query,
    "op13_spelling_variants": spelling.query,
}
SQL = {
    "op2_decontamination": decontamination.SQL,
    "op3_warc": warc.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op9_sharding": sharding.SQL,
    "op10_chat_rotation": chat_rotation.SQL,
    "op11_centroids": centroids.SQL,
    "op13_spelling_variants": spelling.SQL,
}
