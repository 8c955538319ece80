"""The registered queries of the training-data operators and, where SQL can express one, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe
from .decontaminate import OP1_SQL, op1_decontaminate
from .embeddings import OP3_SQL, op3_embeddings
from .langid import op9_language
from .pages import op5_pages
from .periodic import op12_runs
from .phrases import OP11_SQL, op11_phrases
from .quality import op2_quality
from .sharding import op8_sharding
from .simhash import op10_simhash
from .substrings import OP4_SQL, op4_substrings
from .token_counts import op6_token_counts
from .toxicity import op13_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_embeddings": op3_embeddings,
    "op4_substrings": op4_substrings,
    "op5_pages": op5_pages,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
    "op11_phrases": op11_phrases,
    "op12_runs": op12_runs,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_embeddings": OP3_SQL, "op4_substrings": OP4_SQL, "op11_phrases": OP11_SQL}
