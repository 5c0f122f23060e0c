"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from lawloom.llm import decontamination, line_chunks, media, mixing, quality, sharding, simhash, substring, suffix_array, url_filter

QUERIES = {
    "op1_suffix_array_dedup": suffix_array.op1_suffix_array_dedup,
    "op2_spaced_seed_decontamination": decontamination.op2_spaced_seed_decontamination,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_simhash_bktree": simhash.op5_simhash_bktree,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_feistel_sharding": sharding.op8_feistel_sharding,
    "op9_media_sequences": media.op9_media_sequences,
    "op10_line_chunk_dedup": line_chunks.op10_line_chunk_dedup,
}
ORACLES = {"op3_url_filter": url_filter.SQL, "op4_substring_dedup": substring.SQL, "op6_source_mixing": mixing.SQL}
