"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from . import decontaminate, line_dedup, lm_score, mixing, periodic, quality, secret_scan, sharding, simhash, substring_dedup, suffix_array, token_counts, vector_codes

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_lm_score": lm_score.query,
    "op3_token_counts": token_counts.query,
    "op4_quality": quality.query,
    "op5_simhash": simhash.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_mixing": mixing.query,
    "op9_sharding": sharding.query,
    "op10_secrets": secret_scan.query,
    "op11_suffix_array": suffix_array.query,
    "op12_periodic_runs": periodic.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_quality": quality.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_suffix_array": suffix_array.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
