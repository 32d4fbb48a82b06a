"""The operators' queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, html_extract, mtree, near_dedup, packing, quality, secrets, sharding, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_packing": packing.op6_packing,
    "op7_sharding": sharding.op7_sharding,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_top_k": mtree.op10_top_k,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_top_k": mtree.ORACLE_SQL,
}
