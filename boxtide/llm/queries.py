"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op4_decontamination
from .embedding_dedup import OP9_SQL, op9_embedding_dedup
from .language_id import op7_language_id
from .packing import op6_packing
from .token_files import op2_token_files
from .lm_scoring import op3_lm_scoring
from .line_dedup import OP5_SQL, op5_line_dedup
from .sharding import OP8_SQL, op8_sharding
from .phrases import OP13_SQL, op13_phrases
from .simhash import op1_simhash
from .suffix_dedup import OP11_SQL, op11_suffix_dedup
from .url_filter import OP10_SQL, op10_url_filter
from .word_runs import OP12_SQL, op12_word_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op8_sharding": op8_sharding,
    "op4_decontamination": op4_decontamination,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op7_language_id": op7_language_id,
    "op6_packing": op6_packing,
    "op2_token_files": op2_token_files,
    "op3_lm_scoring": op3_lm_scoring,
    "op10_url_filter": op10_url_filter,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_word_runs": op12_word_runs,
    "op13_phrases": op13_phrases,
}

SQL: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op8_sharding": OP8_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op12_word_runs": OP12_SQL,
    "op13_phrases": OP13_SQL,
}
