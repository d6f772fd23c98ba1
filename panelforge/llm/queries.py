"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import oracle, queries_a, queries_b, queries_c, queries_d

QUERIES = {
    "op1_token_ids": queries_b.op1_token_ids,
    "op2_simhash": queries_a.op2_simhash,
    "op3_decontamination": queries_c.op3_decontamination,
    "op4_suffix_arrays": queries_c.op4_suffix_arrays,
    "op5_token_counts": queries_b.op5_token_counts,
    "op6_passages": queries_c.op6_passages,
    "op7_language": queries_c.op7_language,
    "op8_byte_bpe": queries_b.op8_byte_bpe,
    "op9_line_dedup": queries_c.op9_line_dedup,
    "op10_minhash": queries_c.op10_minhash,
    "op11_periodic_runs": queries_d.op11_periodic_runs,
    "op12_hard_negatives": queries_d.op12_hard_negatives,
    "op13_nearest": queries_d.op13_nearest,
    "minhash_near_duplicates": queries_c.minhash_near_duplicates,
}
ORACLE: dict[str, str] = {"op3_decontamination": oracle.OP3, "op4_suffix_arrays": oracle.OP4, "op12_hard_negatives": oracle.OP12}
