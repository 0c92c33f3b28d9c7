"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from sealtable.llm import archives, bpe, counting, fingerprints, jaccard, merkle, negatives, packing, ring, shards, substrings, toxicity, vectors

QUERIES = {
    "op1_warc": archives.op1_warc,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_near_vectors": vectors.op6_near_vectors,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_token_counts": counting.op8_token_counts,
    "op9_training_order": shards.op9_training_order,
    "op10_packing": packing.op10_packing,
    "op11_ring_shards": ring.op11_ring_shards,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_warc": archives.ORACLE,
    "op3_jaccard_join": jaccard.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
