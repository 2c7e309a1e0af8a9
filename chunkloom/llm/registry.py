"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import oracles
from chunkloom.llm.language_id import op7_language_id
from chunkloom.llm.lm_scoring import op8_lm_scoring
from chunkloom.llm.mixing import op3_mixing
from chunkloom.llm.packing import op5_packing
from chunkloom.llm.quality_classifier import op2_quality_classifier
from chunkloom.llm.quality_rules import op1_quality_rules
from chunkloom.llm.simhash import op6_simhash
from chunkloom.llm.substring_dedup import op9_substring_dedup
from chunkloom.llm.token_counts import op4_token_counts
from chunkloom.llm.topk_search import op10_topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_quality_rules, op2_quality_classifier, op3_mixing, op4_token_counts, op5_packing, op6_simhash, op7_language_id, op8_lm_scoring, op9_substring_dedup, op10_topk_search)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
