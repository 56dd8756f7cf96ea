"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP7_SQL, op7_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op5_language_id
from .ngram_jaccard import OP10_SQL, op10_ngram_jaccard
from .packing import op9_packing
from .personal_data import op12_personal_data
from .quality_rules import op2_quality_rules
from .secret_scans import op3_secret_scans
from .sentencepieces import op6_sentencepieces
from .sharding import op1_sharding
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .vector_codes import op13_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_quality_rules,
        op3_secret_scans,
        op4_substring_dedup,
        op5_language_id,
        op6_sentencepieces,
        op7_exact_dedup,
        op8_suffix_dedup,
        op9_packing,
        op10_ngram_jaccard,
        op11_hard_negatives,
        op12_personal_data,
        op13_vector_codes,
    )
}

ORACLES: dict[str, str] = {
    "op4_substring_dedup": OP4_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_ngram_jaccard": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
}
