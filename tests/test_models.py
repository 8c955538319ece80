"""Folds, boosted trees on rows that they have not seen, masked columns of the anomaly model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import ml
from logloom.plans import registry

registry.load_all()
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bucket_rows", [100_000, 20, 1])
def test_folds_are_even(spark, bucket_rows):
    rows = [(i, [0, 1, 1, None][i % 4] if i < 400 else 2) for i in range(403)] + [(None, 1), (5, 1)]
    out = ml.stratified_folds(spark.createDataFrame(rows, "id long, label int"), "label", "id", bucket_rows=bucket_rows)
    assert out.columns == ["id", "label", "fold"]
    assert out.count() == len(rows)
    for label in (0, 1, 2, None):
        sizes = [r["count"] for r in out.filter(F.col("label").eqNullSafe(F.lit(label))).groupBy("fold").count().collect()]
        assert max(sizes) - (min(sizes) if len(sizes) == 5 else 0) <= 1
    assert ml.stratified_folds(out.select("id", "label").filter("false"), "label", "id").count() == 0


def test_trees_judge_rows_they_have_not_seen(spark):
    scored = registry.QUERIES["m6_cross_validated"](spark, DATA)
    rows = scored.toPandas()
    assert rows.event_id.is_unique
    assert len(rows) == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert set(rows.fold) == set(range(5))
    folds = ml.fold_metrics(spark.createDataFrame(rows)).toPandas()
    assert len(folds) == 5
    assert folds.f1.min() > 0.85
    assert abs(folds.n - len(rows) / 5).max() <= 2
    tp = ((rows.model_score >= 0.5) & (rows.label == 1)).sum()
    by_source = ml.fold_metrics(spark.createDataFrame(rows), by="source").toPandas()
    assert by_source.n.sum() == len(rows)
    assert abs((by_source.recall * rows.groupby("source").label.sum().reindex(by_source.source).to_numpy()).sum() - tp) < 1e-6


def test_folds_are_made_once(spark):
    """Scores and fits read a written table; each worked out the folds from the events before."""
    plan = registry.QUERIES["m6_cross_validated"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "events.parquet" not in plan


def test_labels_that_noise_has_are_not_learned(spark):
    """Out-of-fold scores of labels without any pattern are no better than a guess."""
    draw = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(y)) for i, (a, b, y) in enumerate(zip(draw.random(600), draw.random(600), draw.integers(0, 2, 600), strict=True))]
    df = ml.stratified_folds(spark.createDataFrame(rows, "id long, a double, b double, label int"), "label", "id")
    scored = ml.cross_validated(df, ["a", "b"], rounds=3, depth=4)[1].toPandas()
    assert abs(((scored.model_score >= 0.5) == (scored.label == 1)).mean() - 0.5) < 0.1


def test_masked_columns_do_not_count(spark):
    draw = np.random.default_rng(2)
    rows = [(i, float(x), float(2 * x + 0.1 * e), float(s), "ab"[i % 2]) for i, (x, e, s) in enumerate(zip(draw.standard_normal(300), draw.standard_normal(300), draw.standard_normal(300), strict=True))]
    df = spark.createDataFrame([*rows, (900, 0.0, 30.0, 0.0, "a")], "id long, x double, y double, state double, source string")
    model = ml.train_anomaly(df.filter("id < 900"), ["x", "y", "state"], k=1, masked=["state"])
    score = lambda d: {r.id: (r.error, r.anomaly) for r in ml.score_anomaly(model, d, "source", df.filter("id < 900")).collect()}
    a, b = score(df), score(df.withColumn("state", F.lit(1e9)))
    assert a == b
    assert a[900][1] == 1.0
    assert all(e >= 0 and 0 <= s <= 1 for e, s in a.values())
    # by hand: what the first component of the two other columns leaves
    z = np.array([[r[1], r[2]] for r in rows])
    mean, std = z.mean(0), z.std(0, ddof=1)
    z = (z - mean) / std
    main = np.linalg.eigh(z.T @ z)[1][:, -1]
    left = np.sqrt(np.maximum((z * z).sum(1) - (z @ main) ** 2, 0))
    assert np.allclose([a[i][0] for i in range(300)], left, atol=1e-6)
    for k, source in enumerate("ab"):
        assert np.allclose([a[i][1] for i in range(k, 300, 2)], np.minimum(left[k::2] / np.percentile(left[k::2], 99), 1), atol=1e-6), source
