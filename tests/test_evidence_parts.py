"""Leaves numbered in parts, chains of many anchors, the radar's measures on a few rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from logloom.operators import evidence, rollups


@pytest.mark.parametrize("rows", [10_000, 60, 7])
def test_leaves_are_numbered_over_parts(spark, monkeypatch, rows):
    """One batch holds most leaves, and none of its parts is larger than it should be."""
    made = [(0 if i % 10 else i % 7, (i * 7919) % 1000, f"{i:04d}") for i in range(1000)]
    leaves = spark.createDataFrame(made, "batch long, id long, leaf string").repartition(5)
    got = {(r.batch, r.pos): r.leaf for r in evidence.numbered_leaves(leaves, "batch", ["id"], "leaf", rows).collect()}
    want = {}
    for b in range(7):
        for pos, (_, _, leaf) in enumerate(sorted((x for x in made if x[0] == b), key=lambda x: x[1])):
            want[b, pos] = leaf
    assert got == want
    roots = lambda: {tuple(r) for r in evidence.merkle_roots(leaves, "batch", ["id"]).collect()}
    whole = roots()
    monkeypatch.setattr(evidence.numbered_leaves, "__defaults__", (rows,))
    assert roots() == whole
    assert evidence.numbered_leaves(leaves.filter("false"), "batch", ["id"], "leaf").count() == 0


def test_chains_of_several_tables(spark):
    rows = [(t, i, f"{t}{i}") for t in ("a", "b", None) for i in range(3000 if t == "a" else 3)]
    got = {}
    for r in evidence.chain_roots(spark.createDataFrame(rows, "table_name string, batch long, merkle_root string").repartition(7)).collect():
        got.setdefault(r.table_name, {})[r.batch] = r.chained
    for t in ("a", "b", None):
        last = None
        for i in range(len(got[t])):
            last = f"{t}{i}" if last is None else hashlib.sha256(f"{last}{t}{i}".encode()).hexdigest()
            assert got[t][i] == last


def test_stability_of_attributions(spark):
    rows = [(1, "a", 3.0), (1, "b", -2.0), (1, "c", 1.0), (2, "a", 1.0), (2, "b", 2.0), (2, "c", -3.0), (5, "c", 9.0), (5, "b", 1.0), (5, "new", 5.0), (6, "other", 1.0), (7, "other", 2.0), (7, "x", 2.0)]
    got = {r.window: (r.features, r.stability) for r in rollups.attribution_stability(spark.createDataFrame(rows, "w int, feature string, value double"), "w").collect()}
    assert got == {2: (3, -1.0), 5: (2, 1.0), 7: (1, 1.0)}


def test_fairness_needs_two_groups(spark):
    rows = [("a", "true_positive")] * 6 + [("a", None)] * 6 + [("b", "true_positive")] * 9 + [("b", "x")] * 3 + [("few", "x")] * 3
    df = spark.createDataFrame(rows, "source string, label string")
    assert tuple(rollups.true_positive_fairness(df, "source").first()) == (2, 0.25, 0.75)
    assert tuple(rollups.true_positive_fairness(df.filter("source = 'a'"), "source").first()) == (1, 0.0, 0.85)
    assert rollups.true_positive_fairness(df.filter("false"), "source").first().fairness == 0.85
    assert rollups.top_categories(df.withColumn("c", F.nullif("source", F.lit("few"))), "c", 1).collect()[0].n == 12
