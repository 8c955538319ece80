"""Aggregations and roll-ups over event tables (inventory E).

Roll-ups keep mergeable measures: ``merge_rollup`` adds up old and new partial results by their keys. Each is one
``groupBy`` with partial aggregation before its only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalar import score_bucket, severity_weight

EPOCH = "1970-01-01 00:00:00"


def epoch_seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket of so many seconds that a time without zone falls in."""
    start = (F.floor(epoch_seconds(ts) / seconds) * seconds).cast("long")
    return F.timestamp_add("SECOND", start, F.lit(EPOCH).cast("timestamp_ntz"))


def events_per_bucket(feeds: list[tuple[DataFrame, Column, Column]], ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Counts per bucket, source and level over several feeds of (frame, source, level)."""
    parts = [df.select(time_bucket(F.col(ts), seconds).alias("bucket"), source.cast("string").alias("source"), level.cast("string").alias("level")) for df, source, level in feeds]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both.groupBy("bucket", "source", "level").agg(F.count("*").alias("events"))


def severity_hourly(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(time_bucket(F.col(ts), 3600).alias("hour"), "category", "severity").agg(F.count("*").alias("events"))


def entity_frequency(df: DataFrame, keys: list[str], action: str, ts: str = "ts", sketch: bool = False) -> DataFrame:
    """Per minute and entity: events, distinct actions, least and greatest severity.

    With ``sketch`` the distinct actions are a mergeable sketch instead of an exact count.
    """
    distinct = F.hll_sketch_agg(action).alias("actions_sketch") if sketch else F.count_distinct(action).alias("unique_actions")
    return df.groupBy(time_bucket(F.col(ts), 60).alias("minute"), *keys).agg(F.count("*").alias("events"), distinct, F.min("severity").alias("min_severity"), F.max("severity").alias("max_severity"))


def entity_hour_baseline(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Per entity and hour of day: days seen, mean and population deviation of the daily counts (E5)."""
    daily = df.groupBy(*keys, F.to_date(ts).alias("date"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    sums = daily.groupBy(*keys, "hour").agg(F.count("*").alias("days"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    mean = F.col("total") / F.col("days")
    return sums.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.col("squares") / F.col("days") - mean * mean, F.lit(0.0)))})


def score_rollup(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Per hour, source and action: count, sum and maximum of the score."""
    return df.groupBy(time_bucket(F.col(ts), 3600).alias("hour"), "source", "action").agg(F.count("*").alias("n"), F.sum("score").alias("score_sum"), F.max("score").alias("score_max"))


def template_counts(df: DataFrame, template: str = "template", ts: str = "ts") -> DataFrame:
    return df.groupBy(template, "source").agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def merge_rollup(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str] = (), mins: list[str] = (), maxs: list[str] = (), sketches: list[str] = ()) -> DataFrame:
    """Partial results of the same keys in one row each."""
    measures = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in mins] + [F.max(c).alias(c) for c in maxs] + [F.hll_union_agg(c).alias(c) for c in sketches]
    return old.unionByName(new).groupBy(*keys).agg(*measures)


def rollup_staleness(tables: dict[str, DataFrame], as_of: Column, ts: str = "ts", limit_s: int = 300) -> DataFrame:
    """Seconds since the newest row of each table, and whether that is too long."""
    parts = [df.agg(F.max(ts).alias("newest")).select(F.lit(name).alias("table"), "newest") for name, df in tables.items()]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    age = F.timestamp_diff("SECOND", F.col("newest"), as_of)
    return both.select("table", age.alias("age_s"), (age > limit_s).alias("stale"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both


def ingest_rate(df: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """Events a second: of the last full minute, else the mean of the last hour, else of all time."""
    now, at = epoch_seconds(as_of), epoch_seconds(F.col(ts))
    minute = F.floor(now / 60) * 60
    one = df.agg(
        F.count_if((at >= minute - 60) & (at < minute)).alias("minute"),
        F.count_if((at >= now - 3600) & (at < now)).alias("hour"),
        (F.count("*") / F.greatest(F.max(at) - F.min(at), F.lit(1))).alias("overall"),
    )
    return one.select(F.coalesce(F.nullif(F.col("minute") / 60, F.lit(0.0)), F.nullif(F.col("hour") / 3600, F.lit(0.0)), F.col("overall")).alias("events_per_s"))


def count_by(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Counts of keys, the largest first, the keys themselves breaking ties."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts if limit is None else counts.orderBy(F.desc("n"), *keys).limit(limit)


def technique_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("technique").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"))


def technique_timeline(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(time_bucket(F.col(ts), 3600).alias("hour"), "technique").agg(F.count("*").alias("n"))


def tactic_heatmap(df: DataFrame) -> DataFrame:
    return df.groupBy("tactic").agg(F.count_distinct("technique").alias("techniques"), F.count("*").alias("alerts"))


def risky_entities(df: DataFrame, kinds: dict[str, str], limit: int = 8) -> DataFrame:
    """Entities of several kinds by the sum of their severity weights (E15): each row is exploded to its entities, so
    the table is read once."""
    entities = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("entity")) for kind, c in kinds.items()]))
    rows = df.select(entities.alias("e"), severity_weight(F.col("severity")).alias("weight"))
    sums = rows.groupBy("e.kind", "e.entity").agg(F.sum("weight").alias("risk"), F.count("*").alias("events"))
    return sums.orderBy(F.desc("risk"), "kind", "entity").limit(limit)


def risk_score(df: DataFrame) -> DataFrame:
    """Severity-weighted share of the worst case, from 0 to 100."""
    return df.agg((F.sum(severity_weight(F.col("severity"))) / (F.count("*") * 25) * 100).alias("risk"))


def risk_trend(df: DataFrame, as_of: Column, seconds: int, ts: str = "ts") -> DataFrame:
    """Change in percent of events of severity 3 and more between the last two spans."""
    age = epoch_seconds(as_of) - epoch_seconds(F.col(ts))
    severe = F.col("severity") >= 3
    one = df.agg(F.count_if(severe & (age >= 0) & (age < seconds)).alias("now"), F.count_if(severe & (age >= seconds) & (age < 2 * seconds)).alias("before"))
    return one.select("now", "before", F.when(F.col("before") > 0, (F.col("now") - F.col("before")) / F.col("before") * 100).otherwise(0.0).alias("trend"))


def mttr(df: DataFrame, key: str = "category", ts: str = "ts") -> DataFrame:
    """Mean over categories of the span of their severe events, where there are two at least."""
    spans = df.filter("severity >= 3").groupBy(key).agg(F.count("*").alias("n"), (F.max(epoch_seconds(F.col(ts))) - F.min(epoch_seconds(F.col(ts)))).alias("span"))
    return spans.filter("n >= 2").agg(F.avg("span").alias("mttr_s"))


def ioc_table(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy("src_ip", "source", "technique", "tactic").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def evidence_summary(anchors: DataFrame) -> DataFrame:
    return anchors.agg(F.sum("leaf_count").alias("leaves"), F.count("*").alias("batches"), F.avg("leaf_count").alias("mean_leaves"), F.count_if("verified").alias("verified"), (F.count_if("verified") / F.count("*") * 100).alias("verified_rate"))


def verdict_breakdown(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """True and false positives and the precision."""
    tp, fp = F.count_if(F.col(verdict) == "true_positive"), F.count_if(F.col(verdict) == "false_positive")
    return df.agg(tp.alias("tp"), fp.alias("fp"), F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"))


def score_histogram(df: DataFrame, score: str = "score") -> DataFrame:
    return df.groupBy(score_bucket(F.col(score)).alias("bucket")).agg(F.count("*").alias("n"))


def model_score_stats(df: DataFrame, models: list[str], action: str = "action") -> DataFrame:
    """Mean, population deviation and share over one half of each model's scores (E22): one pass, then unpivoted."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])).alias("m"), action)
    return long.groupBy("m.model").agg(F.avg("m.score").alias("mean"), F.stddev_pop("m.score").alias("std"), (F.count_if(F.col("m.score") > 0.5) / F.count("*")).alias("over_half"), (F.count_if(F.col(action) == "escalate") / F.count("*")).alias("escalate_rate"), (F.count_if(F.col(action) == "discard") / F.count("*")).alias("discard_rate"))


def escalation_parity(df: DataFrame, key: str = "source", least: int = 20) -> DataFrame:
    """Escalation rates of sources with enough rows, their extremes and the ratio of these."""
    rates = df.groupBy(key).agg(F.count("*").alias("n"), (F.count_if(F.col("action") == "escalate") / F.count("*")).alias("rate")).filter(F.col("n") >= least)
    return rates.agg(F.count("*").alias("sources"), F.min("rate").alias("least"), F.max("rate").alias("greatest"), F.when(F.max("rate") > 0, F.min("rate") / F.max("rate")).otherwise(1.0).alias("parity"))


def confusion_counts(truth: Column, flagged: Column) -> list[Column]:
    return [F.count_if(truth & flagged).alias("tp"), F.count_if(~truth & flagged).alias("fp"), F.count_if(truth & ~flagged).alias("fn"), F.count_if(~truth & ~flagged).alias("tn")]


def equalized_odds(df: DataFrame, truth: Column, flagged: Column, key: str = "source", least: int = 5) -> DataFrame:
    """Confusion counts, TPR and FPR of each source with enough rows."""
    c = df.groupBy(key).agg(F.count("*").alias("n"), *confusion_counts(truth, flagged)).filter(F.col("n") >= least)
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return c.withColumns({"tpr": rate("tp", "fn"), "fpr": rate("fp", "tn")})


def agent_radar(df: DataFrame) -> DataFrame:
    """One row of quality measures of the scoring models."""
    return df.agg(F.avg("score").alias("confidence"), (1 - (F.max("score") - F.min("score"))).alias("evenness"), (1 - F.avg(F.abs(F.col("score2") - F.col("score3")))).alias("agreement"), F.avg((F.col("action") == "escalate").cast("double")).alias("escalated"))


def attribution_stability(attributions: DataFrame, window: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """(window, features, stability) of every two successive windows, under the later one: the rank agreement of their features
    by mean absolute attribution, from -1 to 1 (E25).

    Features that both windows have are ranked anew among these, equal means by name; a single one agrees with itself.
    Windows follow each other by their order, however far apart. A row for each window and feature is all that is joined.
    """
    means = attributions.groupBy(F.col(window).alias("window"), F.col(feature).alias("feature")).agg(F.avg(F.abs(value)).alias("mean"))
    windows = means.select("window").distinct()
    # as many rows as there are windows
    pairs = windows.select("window", F.lag("window").over(Window.orderBy("window")).alias("before")).filter("before is not null")
    now = means.join(pairs, "window")
    both = now.join(means.select(F.col("window").alias("before"), "feature", F.col("mean").alias("mean_before")), ["before", "feature"])
    rank = lambda by: F.row_number().over(Window.partitionBy("window").orderBy(F.desc(by), "feature"))
    ranked = both.withColumn("_d", (rank("mean") - rank("mean_before")).cast("double"))
    n = F.count("*")
    agreement = F.when(n < 2, 1.0).otherwise(1 - 6 * F.sum(F.col("_d") * F.col("_d")) / (n * (n * n - 1)))
    return ranked.groupBy("window").agg(n.alias("features"), agreement.alias("stability"))


def true_positive_fairness(labelled: DataFrame, by: str, label: str = "label", least: int = 10) -> DataFrame:
    """(groups, spread, fairness): one less the spread of the rates of true positives over groups of ten rows and more; 0.85 where
    there are fewer than two (E25)."""
    rates = labelled.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.coalesce(F.col(label), F.lit("")) == "true_positive").cast("double")).alias("rate")).filter(F.col("n") >= least)
    spread = F.max("rate") - F.min("rate")
    return rates.agg(F.count("*").alias("groups"), F.coalesce(spread, F.lit(0.0)).alias("spread"), F.when(F.count("*") < 2, 0.85).otherwise(F.greatest(F.lit(0.0), 1 - spread)).alias("fairness"))


def radar_rows(confidences: dict[str, tuple[DataFrame, str]], stability: DataFrame, psi: DataFrame, fairness: DataFrame) -> DataFrame:
    """(agent, measure, value): each agent's mean confidence, at most 1, and for all of them the mean stability of attributions,
    one less the drift ``psi``, at least 0, and the fairness (E25)."""
    rows = lambda df, agent, measure, value: df.agg(value.cast("double").alias("value")).select(F.lit(agent).alias("agent"), F.lit(measure).alias("measure"), "value")
    out = rows(stability, "all", "stability", F.avg("stability"))
    out = out.unionByName(rows(psi, "all", "drift resistance", F.greatest(F.lit(0.0), 1 - F.max("psi")))).unionByName(rows(fairness, "all", "fairness", F.max("fairness")))
    for agent, (df, column) in confidences.items():
        out = out.unionByName(rows(df, agent, "confidence", F.coalesce(F.least(F.avg(column), F.lit(1.0)), F.lit(0.0))))
    return out


def rule_severities(df: DataFrame, rules: DataFrame) -> DataFrame:
    """(severity, rules, fired, events): active rules of each severity, those whose technique was seen, and rows with it.

    A technique of several rules counts for each of them."""
    seen = df.groupBy("technique").agg(F.count("*").alias("events"))
    met = rules.filter("status = 'active'").join(seen, "technique", "left")
    return met.groupBy("severity").agg(F.count("*").alias("rules"), F.count("events").alias("fired"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def top_categories(df: DataFrame, category: str, limit: int = 10) -> DataFrame:
    """The categories with most rows, empty ones left out."""
    return df.filter(F.coalesce(F.col(category), F.lit("")) != "").groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(limit)


def rule_coverage(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct techniques of the rules that were seen, over all distinct techniques seen."""
    seen = df.select("technique").distinct()
    known = rules.select("technique").distinct().withColumn("known", F.lit(1))
    return seen.join(F.broadcast(known), "technique", "left").agg(F.count("*").alias("seen"), F.count("known").alias("covered"), (F.count("known") / F.count("*")).alias("coverage"))


def investigation_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.expr("status = 'open'")).alias("open"), F.count_if(F.expr("status = 'completed'")).alias("completed"), F.count_if(F.expr("severity = 4")).alias("critical"), F.count_if(F.expr("severity = 3")).alias("high"))


def host_network_context(df: DataFrame) -> DataFrame:
    return df.groupBy("host").agg(F.count("*").alias("flows"), F.count_distinct("dst_ip").alias("destinations"), F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_port").alias("ports"))


def descending_sums(by: DataFrame, order: str, sums: dict[str, str], ranges: int = 64) -> DataFrame:
    """``by`` with running sums from the greatest ``order`` down: new name to summed column.

    ``order`` has each value once. Rows are summed within ranges of it, whose bounds are quantiles, and to these are
    added the totals of the ranges above, so no task holds all rows. The bounds are all that reaches the driver.
    """
    found = by.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(found))]).cast(f"array<{dict(by.dtypes)[order]}>")
    held = by.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(order))))
    within = Window.partitionBy("_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = held.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(above), F.lit(0)).alias(f"_{name}") for name in sums])
    summed = held.withColumns({name: F.sum(c).over(within) for name, c in sums.items()}).join(F.broadcast(offsets), "_range")
    return summed.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_range", *[f"_{name}" for name in sums])


def confusion_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, false-positive rate, ROC-AUC and average precision.

    Scores are counted once each; the curves are then sums over distinct scores, so no window holds all rows.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    curve = descending_sums(by, "s", {"tp": "pos", "fp": "neg"}).withColumn("hit", F.col("s") >= threshold)
    total = curve.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.when(F.col("hit"), F.col("pos")).otherwise(0)).alias("TP"), F.sum(F.when(F.col("hit"), F.col("neg")).otherwise(0)).alias("FP"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    precision, recall = F.try_divide("TP", F.col("TP") + F.col("FP")), F.try_divide("TP", F.col("P"))
    return total.select(((F.col("TP") + F.col("N") - F.col("FP")) / (F.col("P") + F.col("N"))).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"), F.try_divide("FP", F.col("N")).alias("fpr"), F.try_divide("area", F.col("P") * F.col("N")).alias("roc_auc"), F.try_divide("ap", F.col("P")).alias("average_precision"))


def dataset_profile(df: DataFrame, dataset: str, label: str, kind: str, severity: str) -> DataFrame:
    """Rows, label mix, distinct types and the severity gap of attacks over normal rows, a sign of leaks."""
    gap = F.avg(F.when(F.col(label) == 1, F.col(severity))) - F.avg(F.when(F.col(label) == 0, F.col(severity)))
    return df.groupBy(dataset).agg(F.count("*").alias("n"), F.avg(label).alias("attack_share"), F.count_distinct(kind).alias("types"), gap.alias("severity_gap")).withColumn("leak_warning", F.coalesce(F.col("severity_gap") >= 1.0, F.lit(False)))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Count and order-free hash of a frame."""
    return df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))).alias("fingerprint"))


def attribution_interactions(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """Pairs of features that stand together in rows' attribution lists."""
    a = F.col(column)
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(a, lambda y: y["feature"] > x["feature"]), lambda y: F.struct(x["feature"].alias("a"), y["feature"].alias("b"), ((F.abs(x["value"]) + F.abs(y["value"])) / 2).alias("importance")))))
    total = df.agg(F.count("*").alias("rows"))
    sums = df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.avg("p.importance").alias("importance"))
    return sums.crossJoin(F.broadcast(total)).select("a", "b", (F.col("n") / F.col("rows")).alias("rate"), "importance", (F.col("n") / F.col("rows") * F.col("importance")).alias("strength")).orderBy(F.desc("strength"), "a", "b").limit(limit)


def spc_baseline(df: DataFrame, keys: list[str], ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Mean and sample deviation of counts per bucket of each entity."""
    counts = df.groupBy(*keys, time_bucket(F.col(ts), seconds).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std"), F.count("*").alias("buckets"))


def score_summary(df: DataFrame, by: str, score: str = "score") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("greatest"), F.percentile(score, F.lit(0.5)).alias("median"), F.percentile(score, F.lit(0.95)).alias("p95"), F.count_if(F.expr("action = 'escalate'")).alias("escalated"), F.count_if(F.expr("action = 'monitor'")).alias("monitored"), F.count_if(F.expr("action = 'discard'")).alias("discarded"))


def class_separation(df: DataFrame, attack: Column, score: str = "score") -> DataFrame:
    """Median score of attacks minus that of normal rows."""
    return df.agg((F.percentile(F.when(attack, F.col(score)), F.lit(0.5)) - F.percentile(F.when(~attack, F.col(score)), F.lit(0.5))).alias("separation"))


def newest(df: DataFrame, n: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def top_scores(df: DataFrame, n: int, score: str = "score", key: str = "event_id") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(n)


def report_history(df: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """All reports, and those of the last seven days."""
    return df.agg(F.count("*").alias("reports"), F.count_if(epoch_seconds(as_of) - epoch_seconds(F.col(ts)) < 7 * 86400).alias("last_week"))


def host_score_context(df: DataFrame) -> DataFrame:
    return df.groupBy("host").agg(F.count_if(F.expr("action = 'escalate'")).alias("escalations"), F.avg("score").alias("mean"), F.count_if(F.expr("score >= 0.9")).alias("high"), F.count_if(F.expr("score >= 0.8 and score < 0.9")).alias("medium"))
