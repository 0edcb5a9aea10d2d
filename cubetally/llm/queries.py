"""Queries of the training-data operators, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubetally.llm import binary, decontaminate, edits, jaccard, packing, pii, quality, secrets, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.query,
    "op2_token_output": binary.query,
    "op3_exact_topk": topk.query,
    "op4_quality_classifier": quality.query,
    "op5_jaccard_join": jaccard.query,
    "op6_secret_scans": secrets.query,
    "op7_toxicity": toxicity.query,
    "op8_pii": pii.query,
    "op9_packing": packing.query,
    "op10_token_counts": edits.query,
}

ORACLES: dict[str, str] = {"op1_decontamination": decontaminate.ORACLE, "op3_exact_topk": topk.ORACLE, "op5_jaccard_join": jaccard.ORACLE}
