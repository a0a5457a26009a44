"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, jaccard_join, licenses, oracles, packing, quality, secrets, substring_dedup, suffix_dedup, token_files


def queries():
    import corpus_pipeline

    return {
        "op1_suffix_array_dedup": suffix_dedup.op1,
        "op2_substring_dedup": substring_dedup.op2,
        "op3_best_fit_packing": packing.op3,
        "op4_license_scans": licenses.op4,
        "op5_chat_formatting": chat.op5,
        "op6_ngram_jaccard_join": jaccard_join.op6,
        "op7_benchmark_decontamination": decontaminate.op7,
        "op8_secret_scans": secrets.op8,
        "op9_quality_rules": quality.op9,
        "op10_token_files": token_files.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    import corpus_pipeline

    out = {"op5_chat_formatting": chat.ORACLE} | oracles.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
