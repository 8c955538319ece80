"""Vector search (inventory N)."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.neighbours import nearest_neighbours


def embed(df: DataFrame, text: str, features: int = 256) -> DataFrame:
    """``df`` with ``vector``, unit-length hashed words weighted by rarity."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+").transform(df)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features).transform(words)
    weighted = IDF(inputCol="_counts", outputCol="_weighted").fit(counts).transform(counts)
    return Normalizer(inputCol="_weighted", outputCol="vector").transform(weighted).drop("_words", "_counts", "_weighted")


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, where: Column | None = None, drop_self: bool = False) -> DataFrame:
    """The k nearest of ``corpus`` (id, vector, ...) for each of ``queries`` (query_id, query_vector).

    Exact, by cells that the triangle inequality rules out. ``where`` limits the corpus. Ties go to the smaller id; vectors
    are left out.
    """
    return nearest_neighbours(queries, corpus if where is None else corpus.filter(where), k, drop_self)


def find_similar(corpus: DataFrame, which: Column, k: int) -> DataFrame:
    """The k nearest of stored rows, themselves left out."""
    queries = corpus.filter(which).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vector_search(queries, corpus, k, drop_self=True)


def confirmed_attack_corpus(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Escalated high scores and true positives, with a severity by score or priority."""
    a = scores.filter("action = 'escalate' and score > 0.8").select("event_id", F.when(F.col("score") >= 0.95, 4).otherwise(3).alias("severity"), F.lit("score").alias("origin"))
    b = verdicts.filter("verdict = 'true_positive'").select("event_id", F.when(F.col("priority") == "P1", 4).when(F.col("priority") == "P2", 3).otherwise(2).alias("severity"), F.lit("verdict").alias("origin"))
    return a.unionByName(b)


def incident_corpus(df: DataFrame, text: str) -> DataFrame:
    """Incidents or indicators as (id, text, kind, vector) rows."""
    return embed(df.select("id", F.col(text).alias("text"), "kind"), "text")
