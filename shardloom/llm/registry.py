"""Queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import decontamination, mixing, near_dedup, pseudonyms, quality, role_repair, substring_dedup, token_counts, vector_forest, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_pseudonyms": pseudonyms.query,
    "op3_near_dedup": near_dedup.query,
    "op4_decontamination": decontamination.query,
    "op5_token_counts": token_counts.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_role_repair": role_repair.query,
    "op8_quality": quality.query,
    "op9_mixing": mixing.query,
    "op10_vector_forest": vector_forest.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE_SQL,
    "op3_near_dedup": near_dedup.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
}
