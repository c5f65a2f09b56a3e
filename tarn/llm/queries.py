"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from tarn.llm import chunks, classifier, ctw, mixing, mtree, negatives, pieces, quality, sharding, simhash, suffixes, warc, whitening

QUERIES = {
    "op1_mtree_topk": mtree.op1_mtree_topk,
    "op2_suffix_sorted_dedup": suffixes.op2_suffix_sorted_dedup,
    "op3_additive_quality": classifier.op3_additive_quality,
    "op4_systematic_mix": mixing.op4_systematic_mix,
    "op5_line_first_rules": quality.op5_line_first_rules,
    "op6_simhash_components": simhash.op6_simhash_components,
    "op7_byte_prefix_shards": sharding.op7_byte_prefix_shards,
    "op8_gear_chunk_dedup": chunks.op8_gear_chunk_dedup,
    "op9_context_tree_scores": ctw.op9_context_tree_scores,
    "op10_suffix_array_pieces": pieces.op10_suffix_array_pieces,
    "op11_warc_segments": warc.op11_warc_segments,
    "op12_welford_whitening": whitening.op12_welford_whitening,
    "op13_dual_tree_negatives": negatives.op13_dual_tree_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_mtree_topk": mtree.OP1_SQL,
    "op2_suffix_sorted_dedup": suffixes.OP2_SQL,
    "op4_systematic_mix": mixing.OP4_SQL,
    "op5_line_first_rules": quality.OP5_SQL,
    "op7_byte_prefix_shards": sharding.OP7_SQL,
    "op11_warc_segments": warc.OP11_SQL,
    "op13_dual_tree_negatives": negatives.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
