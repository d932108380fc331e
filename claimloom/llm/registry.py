"""The queries of the training-data operators, by name."""

from __future__ import annotations

import corpus_pipeline
from claimloom.llm import ann, bpe, conversations, line_dedup, merkle, mixing, packing, pii, quality, simhash, suffix_dedup, token_store, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_token_store": token_store.op3_token_store,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_ann": ann.op6_ann,
    "op7_simhash": simhash.op7_simhash,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_bpe": bpe.op12_bpe,
    "op13_conversation_trie": conversations.op13_conversation_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_conversation_trie": conversations.OP13_SQL,
}
