"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_byte_owners
from .classifier import op7_ngram_logistic
from .decontaminate import ORACLE_SQL as WINNOWING_SQL
from .decontaminate import op1_winnowing
from .hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from .hard_negatives import op13_rotated_negatives
from .nn_descent import op11_nn_descent
from .packing import op8_best_fit_packing
from .pii import op4_feistel_pseudonyms
from .quality_rules import op2_quality_rules
from .separators import op6_separator_scan
from .simhash import op3_simhash_dedup
from .suffixes import ORACLE_SQL as SUFFIX_SQL
from .suffixes import op5_sparse_suffix_array
from .urlfilter import ORACLE_SQL as URL_SQL
from .urlfilter import op10_url_trie
from .vbyte import op9_ranked_vbyte


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_winnowing, op2_quality_rules, op3_simhash_dedup, op4_feistel_pseudonyms, op5_sparse_suffix_array, op6_separator_scan, op7_ngram_logistic, op8_best_fit_packing, op9_ranked_vbyte, op10_url_trie, op11_nn_descent, op12_byte_owners, op13_rotated_negatives)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op1_winnowing": WINNOWING_SQL, "op5_sparse_suffix_array": SUFFIX_SQL, "op10_url_trie": URL_SQL, "op13_rotated_negatives": NEGATIVES_SQL}
