"""The operators' queries over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, dedup, language, neighbours, packing, quality, sanitize, sharding, token_counts, url_filter

QUERIES = {
    "op1_near_dedup": dedup.query,
    "op2_sanitise": sanitize.query,
    "op3_url_filter": url_filter.query,
    "op4_sharding": sharding.query,
    "op5_neighbours": neighbours.query,
    "op6_quality": quality.query,
    "op7_language": language.query,
    "op8_packing": packing.query,
    "op9_decontamination": decontaminate.query,
    "op10_token_counts": token_counts.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_near_dedup": dedup.ORACLE, "op3_url_filter": url_filter.ORACLE, "op9_decontamination": decontaminate.ORACLE}
