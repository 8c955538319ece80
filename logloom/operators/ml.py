"""Data sets and models (inventory M): MLlib and DataFrame operators."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalar import sanitize
from logloom.operators.joins import small
from logloom.operators.scratch import written


def build_training_frame(sets: list[DataFrame], numbers: list[str]) -> DataFrame:
    """Union of mapped sets: clean clipped numbers, labels 0 or 1, an attack type for every row (M1)."""
    both = reduce(DataFrame.unionByName, sets)
    clean = {c: F.greatest(F.least(sanitize(F.col(c).cast("double")), F.lit(1e9)), F.lit(-1e9)) for c in numbers}
    label = F.when(F.col("label").cast("int") >= 1, 1).otherwise(0)
    kind = F.coalesce(F.nullif(F.trim("attack_type"), F.lit("")), F.when(label == 1, "unknown").otherwise("normal"))
    return both.withColumns({**clean, "attack_type": kind, "label": label})


def by_hash(key: str, seed: int = 42) -> list[Column]:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)]


def balanced_sample(df: DataFrame, groups: list[str], quota: int, key: str, seed: int = 42) -> DataFrame:
    """Up to a quota of rows of each group, by order of a hash (M2, M4); cut down within tasks before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*by_hash(key, seed)))
    return df.withColumn("_place", place).filter(F.col("_place") <= quota).drop("_place")


def stratified_sample(df: DataFrame, category: str, target: int, key: str, seed: int = 42) -> DataFrame:
    """Rows at a rate of min(1, target / n) in each category, decided by a hash (M3)."""
    rates = df.groupBy(category).agg(F.least(F.lit(1.0), F.lit(float(target)) / F.count("*")).alias("_rate"))
    unit = F.conv(F.substring(by_hash(key, seed)[0], 1, 8), 16, 10).cast("double") / 2**32
    return df.join(small(rates), category).filter(unit < F.col("_rate")).drop("_rate")


def capped_sample(df: DataFrame, categories: list[tuple[str, Column]], caps: dict[str, int], key: str) -> DataFrame:
    """Rows in the first category that they meet, then no more than each key's cap, the earlier categories first (M5)."""
    rank = F.lit(len(categories))
    name = F.lit("other")
    for i in range(len(categories) - 1, -1, -1):
        rank = F.when(categories[i][1], i).otherwise(rank)
        name = F.when(categories[i][1], categories[i][0]).otherwise(name)
    out = df.withColumns({"category": name, "_rank": rank})
    for column, cap in caps.items():
        place = F.row_number().over(Window.partitionBy(column).orderBy("_rank", *by_hash(key)))
        out = out.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
    return out.drop("_rank")


def train_classifier(df: DataFrame, features: list[str], label: str = "label"):
    """A class-weighted classifier over assembled features (M6)."""
    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    weighted = df.withColumn("_w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="_w", maxIter=30, regParam=1e-3)]
    return Pipeline(stages=stages).fit(weighted)


def score_classifier(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("model_score", vector_to_array("probability")[1]).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42, bucket_rows: int = 100_000) -> DataFrame:
    """``df`` with ``fold``, 0 to ``folds`` - 1: of each label as many rows in every fold, but for one (M6).

    Rows are dealt in turn in the order of a hash of the key. The order is cut into buckets by the hash's first digits, so
    many that they hold ``bucket_rows`` rows of the table on average: rows are numbered within buckets, and the rows of the
    buckets before are added, so no window holds a label's rows. Equal keys lie side by side; null labels are a label.
    """
    digits = 1
    while df.count() > bucket_rows * 16**digits:
        digits += 1
    digest = by_hash(key, seed)[0]
    marked = df.withColumns({"_digest": F.coalesce(digest, F.lit("")), "_bucket": F.coalesce(F.substring(digest, 1, digits), F.lit(""))})
    counts = marked.groupBy(label, "_bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(label).alias("_label"), F.col("_bucket").alias("_of"), before.alias("_before"))
    met = marked.join(small(offsets), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_of")))
    place = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_digest", key)) - 1 + F.col("_before")
    return met.withColumn("fold", (place % folds).cast("int")).drop("_digest", "_bucket", "_label", "_of", "_before")


def cross_validated(df: DataFrame, features: list[str], label: str = "label", folds: int = 5, rounds: int = 100, depth: int = 5, rate: float = 0.1):
    """Boosted trees over the ``fold`` column (M6): the model of all rows, and ``df`` with ``model_score``, each row's score by the
    model of the folds that it is not in.

    Labels weigh the same in sum. Every round sees 0.8 of the rows and of the features. Null features count as 0. Rows with their
    folds are written once, with all columns of ``df``: each fit and each fold's scores read that, not what made them.
    """
    sums = df.groupBy(label).count()
    weight = small(sums.select(F.col(label).alias("_label"), (1.0 / F.col("count")).alias("_weight")))
    n = df.count()
    rows = df.join(weight, F.col(label) == F.col("_label")).withColumn("_weight", F.col("_weight") * n / 2).drop("_label")
    filled = rows.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
    assembled = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features").transform(filled).drop(*[f"_f{i}" for i in range(len(features))])
    trees = GBTClassifier(labelCol=label, weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=42)
    table = written(assembled, "folds")
    fit = inheritable_thread_target(df.sparkSession)(lambda i: trees.fit(table if i is None else table.filter(F.col("fold") != i)))
    with ThreadPoolExecutor(2) as pool:
        model, *unseen = pool.map(fit, [None, *range(folds)])
    scored = [m.transform(table.filter(F.col("fold") == i)) for i, m in enumerate(unseen)]
    out = reduce(DataFrame.unionByName, scored).withColumn("model_score", vector_to_array("probability")[1])
    return model, out.drop("features", "rawPrediction", "probability", "prediction", "_weight")


def fold_metrics(scored: DataFrame, label: str = "label", cut: float = 0.5, by: str = "fold") -> DataFrame:
    """Rows, precision, recall and F1 at a cut for each value of ``by``, as of a fold or a source (M6)."""
    hit, true = F.col("model_score") >= cut, F.col(label) == 1
    sums = scored.groupBy(by).agg(F.count("*").alias("n"), F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return sums.select(by, "n", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), f1.alias("f1"))


def _masked(df: DataFrame, features: list[str], masked: list[str]) -> DataFrame:
    return df.withColumns({f"_m{i}": F.lit(0.0) if c in masked else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})


def train_anomaly(df: DataFrame, features: list[str], k: int = 2, masked: list[str] = ()):
    """Scaler and principal components whose reconstruction error is the anomaly score (M7).

    ``masked`` features, as those that hang on a stream's state, are 0 in training and in scoring: they keep their places, and
    no score depends on them.
    """
    stages = [VectorAssembler(inputCols=[f"_m{i}" for i in range(len(features))], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), PCA(k=k, inputCol="_scaled", outputCol="_pc")]
    return Pipeline(stages=stages).fit(_masked(df, features, masked)), list(features), list(masked)


def score_anomaly(model, df: DataFrame, source: str, reference: DataFrame | None = None) -> DataFrame:
    """Reconstruction error over the 99th percentile of its source among ``reference`` rows (``df`` if there are none), 1 at
    most, 0 for a source without any (M7)."""
    pipeline, features, masked = model

    def errors(x: DataFrame) -> DataFrame:
        out = pipeline.transform(_masked(x, features, masked))
        square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, v: s + v * v)
        # components are orthonormal: the error is what the projection leaves of the length
        return out.withColumn("error", F.sqrt(F.greatest(square("_scaled") - square("_pc"), F.lit(0.0)))).drop("_raw", "_scaled", "_pc", *[f"_m{i}" for i in range(len(features))])

    scored = errors(df)
    limits = (errors(reference) if reference is not None else scored).groupBy(source).agg(F.percentile("error", F.lit(0.99)).alias("_p99"))
    return scored.join(small(limits), source, "left").withColumn("anomaly", F.least(F.coalesce(F.try_divide("error", F.col("_p99")), F.lit(0.0)), F.lit(1.0))).drop("_p99")


def feature_attribution(df: DataFrame, score: Column, features: list[str], key: str, top: int = 5) -> DataFrame:
    """Change of a score when each feature is set to 0 in turn: the largest of each row (M8).

    ``score`` is a column expression over the features; each row is exploded to one variant for each feature.
    """
    variants = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[(F.lit(0.0) if g == f else F.col(g).cast("double")).alias(g) for g in features]) for f in features]))
    base = df.select(key, *features).withColumn("_base", score)
    long = base.select(key, "_base", variants.alias("v")).select(key, "_base", "v.*")
    delta = long.withColumn("value", F.col("_base") - score).select(key, "feature", "value")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature"))
    return delta.withColumn("rank", place).filter(F.col("rank") <= top)


def category_attribution(attributions: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Sum of absolute contributions of each group of features (M9)."""
    group = F.create_map(*[F.lit(x) for p in categories.items() for x in p])[F.col("feature")]
    return attributions.groupBy(F.coalesce(group, F.lit("other")).alias("category")).agg(F.sum(F.abs("value")).alias("contribution"), F.count("*").alias("n"))


def assign_label(score: Column, agreement: Column, strict: bool = True) -> Column:
    """1, 0 or null from ensemble scores, by the stricter or the looser rule."""
    high, low = (0.85, 0.15) if strict else (0.70, 0.30)
    return F.when((score >= high) & (agreement >= 0.7), 1).when((score <= low) & (agreement >= 0.7), 0)


def augment(df: DataFrame, numbers: list[str], copies: int, key: str, noise: float = 0.05) -> DataFrame:
    """Noisy copies of rows: numbers are moved by up to a share of themselves, by a hash of key and copy."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    unit = lambda c: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("copy").cast("string"), F.lit(c))), 1, 8), 16, 10).cast("double") / 2**32
    return out.withColumns({c: F.col(c) * (1 + noise * (2 * unit(c) - 1)) for c in numbers})
