"""Queries and SQL of the subpackage."""

from __future__ import annotations

import corpus_pipeline

from loamfield.llm import decontam, langid, linededup, ngramjoin, periodicity, piecewise, quality, sharding, suffix, tokenpack, topk, toxicity, whitening

QUERIES = {
    "op1_permutation_table_shards": sharding.op1,
    "op2_line_first_quality": quality.op2,
    "op3_rank_order_language": langid.op3,
    "op4_simple8b_token_files": tokenpack.op4,
    "op5_nbest_pieces": piecewise.op5,
    "op6_suffix_array_dedup": suffix.op6,
    "op7_multi_order_jaccard": ngramjoin.op7,
    "op8_deletion_line_dedup": linededup.op8,
    "op9_factorization_toxicity": toxicity.op9,
    "op10_template_decontamination": decontam.op10,
    "op11_limb_covariance_whitening": whitening.op11,
    "op12_automaton_periodic_runs": periodicity.op12,
    "op13_length_sorted_search": topk.op13,
}
ORACLES = {
    "op1_permutation_table_shards": sharding.OP1_SQL,
    "op2_line_first_quality": quality.OP2_SQL,
    "op8_deletion_line_dedup": linededup.OP8_SQL,
    "op13_length_sorted_search": topk.OP13_SQL,
}
pipeline = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
