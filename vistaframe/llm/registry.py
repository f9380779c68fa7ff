"""Queries of the ten operators and their SQL."""

from __future__ import annotations

from . import bpe, hnsw, langid, mixing, neardup, pitman_yor, quality, shard, topk, toxicity

QUERIES = {
    "op1_topk_search": topk.query,
    "op2_quality_classifier": quality.query,
    "op3_bpe": bpe.query,
    "op4_language_id": langid.query,
    "op5_hnsw_neighbours": hnsw.query,
    "op6_minhash_near_dedup": neardup.query,
    "op7_lm_scoring": pitman_yor.query,
    "op8_sharding": shard.query,
    "op9_mixing": mixing.query,
    "op10_toxicity": toxicity.query,
}

SQL = {
    "op1_topk_search": topk.SQL,
    "op6_minhash_near_dedup": neardup.SQL,
    "op9_mixing": mixing.SQL,
}
