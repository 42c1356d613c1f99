"""Query registry of this subpackage: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from inkgauge.llm import ann, jaccard, licences, line_dedup, media, mixing, packing, passages, quality, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_packing": packing.query,
    "op2_mix_sources": mixing.query,
    "op3_ngram_jaccard": jaccard.query,
    "op4_toxicity": toxicity.query,
    "op5_licence_scan": licences.query,
    "op6_media_webp": media.query,
    "op7_nearest_vectors": ann.query,
    "op8_repeated_passages": passages.query,
    "op9_site_quality": quality.query,
    "op10_line_dedup": line_dedup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": jaccard.SQL,
    "op7_nearest_vectors": ann.SQL,
    "op8_repeated_passages": passages.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
