"""Registered queries of the operators in this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fill_in_middle, ranked_search
from .byte_bpe import op8_byte_bpe
from .fill_in_middle import op11_fill_in_middle
from .fingerprints import op5_fingerprints
from .importance import op6_importance
from .lm_scoring import op7_lm_scoring
from .near_dedup import op1_near_dedup
from .packing import op2_packing
from .quality_rules import op9_quality_rules
from .ranked_search import op13_ranked_search
from .substring_dedup import op3_substring_dedup
from .token_counts import op12_token_counts
from .toxicity import op4_toxicity
from .warc import op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprints": op5_fingerprints,
    "op6_importance": op6_importance,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
