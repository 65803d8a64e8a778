"""Queries of the training-data operators, one for each, and the corpus pipeline."""

from __future__ import annotations

from folio.llm import decontaminate, embedding_codes, exact_substrings, importance, license_scan, line_dedup, mixing, near_dedup, periodic_runs, quality_rules, spelling, token_counts, warc


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
        "op6_token_counts": token_counts.op6_token_counts,
        "op10_source_mixing": mixing.op10_source_mixing,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op9_license_scan": license_scan.op9_license_scan,
        "op5_warc": warc.op5_warc,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op2_quality_classifier": importance.op2_quality_classifier,
        "op7_suffix_array_dedup": exact_substrings.op7_suffix_array_dedup,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_embedding_near_dedup": embedding_codes.op13_embedding_near_dedup,
    }


def oracle_sql() -> dict:
    return {"op1_benchmark_decontamination": decontaminate.ORACLE, "op5_warc": warc.ORACLE, "op7_suffix_array_dedup": exact_substrings.ORACLE}
