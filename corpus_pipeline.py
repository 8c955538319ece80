"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

quality: documents that the pairwise ranker scores under the threshold go. near_copies: one document of each group of
linked fingerprints stays. substrings: passages of 35 words and more that repeat are removed from the texts.
decontaminate: documents that contain a benchmark item go. encode: the texts as token ids, and decoded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.bpe import encode_corpus
from logloom.llm.common import drop, save, table
from logloom.llm.decontaminate import drop_contaminated
from logloom.llm.quality import keep_quality
from logloom.llm.simhash import drop_near_copies
from logloom.llm.substrings import drop_repeated_words

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("substrings", drop_repeated_words),
    ("decontaminate", drop_contaminated),
    ("encode", encode_corpus),
]

#: SQL can express neither the trained ranker nor the token merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents``; the result of the last is returned, not written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
