"""The queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

from . import alignment, exact_dedup, lexicon, line_dedup, packing, pieces, pii, prefix_trie, quality, secrets, sharding, simhash, token_files

QUERIES = {
    "op1_pii_deobfuscation": pii.op1_pii_deobfuscation,
    "op2_bounded_ring_sharding": sharding.op2_bounded_ring_sharding,
    "op3_secret_novelty": secrets.op3_secret_novelty,
    "op4_line_chunk_dedup": line_dedup.op4_line_chunk_dedup,
    "op5_risk_controlled_quality": quality.op5_risk_controlled_quality,
    "op6_gumbel_segmentations": pieces.op6_gumbel_segmentations,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_token_files": token_files.op10_token_files,
    "op11_cross_tokenizer_alignment": alignment.op11_cross_tokenizer_alignment,
    "op12_lexicon_bpe": lexicon.op12_lexicon_bpe,
    "op13_conversation_prefix_trie": prefix_trie.op13_conversation_prefix_trie,
}

ORACLES = {
    "op4_line_chunk_dedup": line_dedup.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
