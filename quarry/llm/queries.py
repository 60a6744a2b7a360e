"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, html_extraction, minhash_dedup, periodic_runs, pii, quality_classifier, quality_rules, sentencepieces, suffix_dedup, token_counts, tokenizer_alignment, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.query,
    "op2_minhash_dedup": minhash_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_html_extraction": html_extraction.query,
    "op6_quality_rules": quality_rules.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_sentencepiece": sentencepieces.query,
    "op9_pii": pii.query,
    "op10_token_counts": token_counts.query,
    "op11_tokenizer_alignment": tokenizer_alignment.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_exact_dedup": exact_dedup.query,
}

ORACLE_SQL: dict[str, str] = {"op13_exact_dedup": exact_dedup.SQL}
