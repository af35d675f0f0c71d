"""Queries of this subpackage, as ``__spark_entry__`` lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm.attribution import op1_token_counts
from assaykit.llm.binary import op5_token_binary
from assaykit.llm.decontaminate import OP3_SQL, op3_decontamination
from assaykit.llm.langid import op4_language_id
from assaykit.llm.licences import OP6_SQL, op6_license_scan
from assaykit.llm.lm import op2_lm_scoring
from assaykit.llm.quality import op10_quality_rules
from assaykit.llm.simhash import op8_simhash
from assaykit.llm.toxicity import op7_toxicity
from assaykit.llm.vectorpack import op9_best_fit_packing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_token_binary": op5_token_binary,
        "op6_license_scan": op6_license_scan,
        "op7_toxicity": op7_toxicity,
        "op8_simhash": op8_simhash,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op6_license_scan": OP6_SQL}
