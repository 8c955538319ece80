"""Exact neighbours against all pairs, what pruning spares, blocks, ties and vectors without a distance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import neighbours, vectors


def frame(spark, x):
    return spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(x)], "id long, vector array<double>, label int")


def brute(x, which, k, drop_self=False):
    out = {}
    for i in which:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        ids = sorted((j for j in range(len(x)) if not (drop_self and j == i)), key=lambda j: (round(d[j], 12), j))[:k]
        out[i] = [(j, round(float(d[j]), 9)) for j in ids]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r.label == r.id % 3
        out.setdefault(r.query_id, []).append((r.id, round(r.distance, 9)))
    return out


def clustered(n=4_000, dims=16, centres=60):
    draw = np.random.default_rng(1)
    c = draw.standard_normal((centres, dims)) * 4
    return c[draw.integers(0, centres, n)] + draw.standard_normal((n, dims)) * 0.3


@pytest.mark.parametrize("block", [8_192, 50])
@pytest.mark.parametrize("kind", ["clusters", "no clusters", "ties"])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, kind, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERIES", block)
    x = {"clusters": clustered(1_500), "no clusters": np.random.default_rng(2).standard_normal((700, 12)), "ties": np.repeat(np.random.default_rng(3).integers(0, 3, (40, 3)), 12, axis=0).astype(float)}[kind]
    corpus = frame(spark, x.tolist())
    queries = corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    which = range(0, len(x), 20)
    assert found(vectors.vector_search(queries, corpus, 7)) == brute(x, which, 7)
    assert found(vectors.find_similar(corpus, F.col("id") % 20 == 0, 4)) == brute(x, which, 4, True)


def test_pruning_spares_most_pairs(spark, monkeypatch):
    x = clustered()
    compared = []
    plain = neighbours.search_blocks

    def spy(*args):
        out = plain(*args)
        compared.append(out.groupBy("query_id", "compared").count().agg(F.sum("compared")).first()[0] or 0)
        return out

    monkeypatch.setattr(neighbours, "search_blocks", spy)
    corpus = frame(spark, x.tolist())
    out = vectors.find_similar(corpus, F.col("id") % 20 == 0, 5)
    assert found(out) == brute(x, range(0, len(x), 20), 5, True)
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert sum(compared) < 0.1 * len(x) * len(x) / 20


def test_vectors_without_a_distance(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0], 1), (2, [3.0, 4.0], 2), (3, None, 0), (4, [], 1), (5, [1.0], 2), (6, [nan, 1.0], 0), (7, [inf, 1.0], 1), (8, [None, 1.0], 2)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    queries = corpus.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert found(vectors.vector_search(queries, corpus, 5)) == {1: [(1, 0.0), (2, 5.0)], 2: [(2, 0.0), (1, 5.0)]}
    assert vectors.vector_search(queries, corpus.filter("false"), 5).count() == 0
    assert vectors.vector_search(queries.filter("false"), corpus, 5).count() == 0


def test_queries_are_sent_to_blocks_and_not_to_all_cells(spark, monkeypatch):
    """Where no cell can be ruled out, a query stands once for each block of vectors, not once for each of the cells."""
    monkeypatch.setattr(neighbours, "BLOCK", 1_000)
    sent, plain = [], neighbours.written

    def spy(df, label):
        out = plain(df, label)
        if label == "asked":
            sent.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "written", spy)
    x = np.random.default_rng(7).standard_normal((4_000, 24))
    out = vectors.find_similar(frame(spark, x.tolist()), F.col("id") % 20 == 0, 5)
    assert found(out) == brute(x, range(0, len(x), 20), 5, True)
    assert sum(sent) <= 200 * (2 + 6)  # around each query, and blocks of up to 1,000; there are 62 cells
