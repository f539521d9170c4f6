"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from .bpe import op9_bpe_encode_decode
from .embedding_dedup import op5_embedding_near_dedup
from .licenses import op2_license_scan
from .line_dedup import OP3_SQL, op3_line_dedup
from .minhash import op8_minhash_near_dedup
from .mixing import op10_mix_sources
from .quality import op6_quality_classifier
from .sharding import op1_vector_bin_packing
from .suffix_dedup import op7_suffix_array_dedup
from .topk import OP4_SQL, op4_exact_topk

QUERIES = {
    "op1_vector_bin_packing": op1_vector_bin_packing,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_bpe_encode_decode": op9_bpe_encode_decode,
    "op10_mix_sources": op10_mix_sources,
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op4_exact_topk": OP4_SQL}
