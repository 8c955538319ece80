"""Detection and scoring (inventory G)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import scalar as S
from logloom.functions.normalize import first_match, map_protocol, map_source_type
from logloom.operators.joins import small
from logloom.operators.rollups import descending_sums

# The stage of an attack that an action code stands for.
STAGE_OF_ACTION = {0: 0, 1: 1, 2: 2, 3: 1, 4: 3, 5: 0, 6: 0, 7: 1, 8: 4, 9: 3, 10: 5, 11: 4}


# Names and order of the two feature rows.
FEATURES_V6 = (
    "hour_of_day", "day_of_week", "severity_numeric", "source_type_numeric", "src_bytes", "dst_bytes", "event_freq_1m", "protocol", "dst_port", "threat_intel_flag",
    "duration", "same_srv_rate", "diff_srv_rate", "serror_rate", "rerror_rate", "count", "srv_count", "dst_host_count", "dst_host_srv_count",
)
FEATURES_V7 = (
    "hour_of_day", "day_of_week", "is_off_hours", "severity_numeric", "event_id_risk_score", "action_type", "is_admin_action", "has_known_ioc", "entity_event_rate", "entity_error_rate", "entity_unique_actions", "source_novelty",
    "dst_port", "protocol_numeric", "byte_ratio", "total_bytes_log", "conn_rate_fast", "conn_rate_slow", "rate_acceleration", "port_entropy",
    "message_entropy", "message_length_log", "numeric_ratio", "special_char_ratio", "keyword_threat_score", "template_novelty",
    "host_score_baseline_z", "user_score_baseline_z", "kill_chain_stage", "kill_chain_velocity", "cross_host_correlation", "dns_query_entropy",
)


def features_v6(df: DataFrame) -> DataFrame:
    """``event_id`` and the 19 columns of ``FEATURES_V6``: needs connection features (F4, F5) and ``ioc_match``;
    connection features of rows without addresses are 0."""
    time, size = S.temporal_features(F.col("ts")), S.byte_features(F.col("bytes_out"), F.col("bytes_in"))
    seconds = F.col("duration_ms") / 1000
    conn = {"same_srv_rate": "same_service_rate", "diff_srv_rate": "diff_service_rate", "serror_rate": "serror_rate", "rerror_rate": "rerror_rate", "count": "conn_count", "srv_count": "same_service", "dst_host_count": "host_sources", "dst_host_srv_count": "host_same_service"}
    made = {
        "hour_of_day": time["hour"], "day_of_week": time["weekday"], "severity_numeric": F.col("severity"), "source_type_numeric": map_source_type(F.col("source")),
        "src_bytes": size["sent"], "dst_bytes": size["received"], "event_freq_1m": S.event_freq_1m(seconds), "protocol": map_protocol(F.col("protocol")), "dst_port": F.col("dst_port"),
        "threat_intel_flag": F.col("ioc_match").cast("double"), "duration": seconds,
        **{name: F.when(F.col("dst_ip").isNull(), 0.0).otherwise(S.sanitize(F.col(c).cast("double"))) for name, c in conn.items()},
    }
    return df.select("event_id", *[made[name].alias(name) for name in FEATURES_V6])


def features_v7(df: DataFrame) -> DataFrame:
    """``event_id`` and the 32 columns of ``FEATURES_V7``: needs the rates (F6, F9, F10), port entropy (F7), novelty
    (F8), template rarity (G7) and, for its behavioural part, baselines (F11), stages (G5) and cross-host counts (F12);
    missing ones count as 0, and so does the entropy of a missing ``dns_query``."""
    time, size, text = S.temporal_features(F.col("ts")), S.byte_features(F.col("bytes_out"), F.col("bytes_in")), S.text_stats(F.col("message"))
    have = lambda name: S.sanitize(F.col(name).cast("double")) if name in df.columns else F.lit(0.0)
    given = {
        "event_id_risk_score": "event_risk", "action_type": "action_code", "is_admin_action": "admin_action", "has_known_ioc": "ioc_match", "entity_event_rate": "rate_medium", "entity_error_rate": "error_rate",
        "entity_unique_actions": "unique_actions", "source_novelty": "novelty", "conn_rate_fast": "fast", "conn_rate_slow": "slow", "rate_acceleration": "conn_acceleration", "port_entropy": "port_entropy", "template_novelty": "rarity",
        "host_score_baseline_z": "host_baseline_z", "user_score_baseline_z": "usr_baseline_z", "kill_chain_stage": "chain_stage", "kill_chain_velocity": "chain_velocity", "cross_host_correlation": "cross_hosts",
    }
    made = {
        "hour_of_day": time["hour"], "day_of_week": time["weekday"], "is_off_hours": time["off_hours"], "severity_numeric": F.col("severity"), "dst_port": F.col("dst_port"), "protocol_numeric": map_protocol(F.col("protocol")),
        "byte_ratio": size["ratio"], "total_bytes_log": size["total_log"], "message_entropy": S.char_entropy(F.col("message")), "message_length_log": text["length_log"], "numeric_ratio": text["digit_ratio"],
        "special_char_ratio": text["special_ratio"], "keyword_threat_score": S.keyword_threat_score(F.col("message")), "dns_query_entropy": S.char_entropy(F.col("dns_query")) if "dns_query" in df.columns else F.lit(0.0),
        **{name: have(c) for name, c in given.items()},
    }
    return df.select("event_id", *[made[name].alias(name) for name in FEATURES_V7])


def fuse_scores_v6(a: Column, b: Column, c: Column, c_confidence: Column, rarity: Column, ioc: Column, multiplier: Column, weights=(0.80, 0.12, 0.08), rare=0.15, rarity_boost=0.0, ioc_boost=0.15, override_at=0.85, override_floor=0.42) -> Column:
    """Struct of combined, std, agreement, ci_low, ci_high and adjusted score of three models.

    The third weight counts with its confidence; the rest of it goes to the others in proportion.
    """
    wa, wb, wc = weights
    spare = (1 - c_confidence) * wc
    combined = a * (wa + spare * (wa / (wa + wb))) + b * (wb + spare * (wb / (wa + wb))) + c * (wc * c_confidence)
    mean = (a + b + c) / 3
    std = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3)
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    boost = F.when(rarity < rare, rarity_boost * (1 - rarity / rare)).otherwise(0.0) + F.when(ioc == 1, ioc_boost).otherwise(0.0)
    factor = F.when(ioc == 1, F.greatest(multiplier, F.lit(1.5))).otherwise(multiplier)
    scaled = F.least((combined + boost) * factor, F.lit(1.0))
    adjusted = F.when((b >= override_at) & (scaled < override_floor), override_floor).otherwise(scaled)
    return F.struct(combined.alias("combined"), std.alias("std"), (1 - std).alias("agreement"), clip(combined - 1.96 * std).alias("ci_low"), clip(combined + 1.96 * std).alias("ci_high"), adjusted.alias("adjusted"))


def route_score(adjusted: Column, std: Column, suspicious: Column, anomalous: Column, allowed: Column, disagreement: float = 0.30, floor: float = 0.75) -> Column:
    """escalate, monitor or discard."""
    return first_match([
        (allowed, F.lit("discard")),
        (adjusted >= anomalous, F.lit("escalate")),
        ((adjusted >= suspicious) & (std >= disagreement) & (adjusted >= floor), F.lit("escalate")),
        (adjusted >= suspicious, F.lit("monitor")),
    ], F.lit("discard"))


def fuse_scores_v7(a: Column, b: Column, stage: Column, cross_hosts: Column, ioc: Column, weights=(0.85, 0.15)) -> Column:
    """Struct of the final score, its label and a text of the adjustments made."""
    blended = a * weights[0] + b * weights[1]
    chain = F.when(stage >= 2, 1 + 0.1 * stage).otherwise(1.0)
    spread = F.when(cross_hosts >= 3, 1.2).otherwise(1.0)
    raised = blended * chain * spread
    raised = raised + F.when(ioc == 1, 0.05 + 0.15 * raised).otherwise(0.0)
    gap = F.abs(a - b)
    split = (gap > 0.40) & (F.greatest(a, b) > 0.70) & (F.least(a, b) > 0.30)
    final = F.when(split, F.greatest(raised, 0.90 + 0.05 * F.least(gap, F.lit(1.0)))).otherwise(raised)
    final = F.least(F.greatest(final, F.lit(0.0)), F.lit(1.0))
    label = first_match([(final >= 0.90, F.lit("escalate")), (final >= 0.40, F.lit("monitor"))], F.lit("discard"))
    made = F.concat_ws("; ", F.when(stage >= 2, F.lit("chain")), F.when(cross_hosts >= 3, F.lit("cross-host")), F.when(ioc == 1, F.lit("indicator")), F.when(split, F.lit("disagreement")))
    return F.struct(final.alias("final_score"), label.alias("label"), F.when(made == "", "none").otherwise(made).alias("adjustments"))


def template_rarity(count: Column, total: Column, warm_up: int = 10_000) -> Column:
    """1 - ln(1 + n) / ln(1 + total), clipped; one half before enough rows."""
    rare = F.least(F.greatest(1 - F.log1p(count) / F.log1p(total), F.lit(0.0)), F.lit(1.0))
    return F.when(total < warm_up, 0.5).otherwise(rare)


class TemplateLeaf:
    """The templates of one leaf of the tree, in the order in which they were found.

    A text joins the first template that has enough of its words in their places. Which templates can is told by an index
    from places and words, so that a text meets those that share words with it and not all.
    """

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.templates: list[list[str]] = []
        self.holders: dict[tuple[int, str], list[int]] = {}

    def add(self, tokens: list[str]) -> int:
        self.templates.append(tokens)
        for place in enumerate(tokens):
            self.holders.setdefault(place, []).append(len(self.templates) - 1)
        return len(self.templates) - 1

    def join(self, tokens: list[str]) -> int:
        least = self.similarity * len(tokens)
        shared: Counter[int] = Counter()
        for place in enumerate(tokens):
            shared.update(self.holders.get(place, ()))
        at = min((i for i, n in shared.items() if n >= least), default=None)
        if at is None:
            return self.add(tokens)
        own = self.templates[at]
        for i, (x, y) in enumerate(zip(own, tokens, strict=True)):
            if x != y and x != WILDCARD:
                self.holders[i, x].remove(at)
                own[i] = WILDCARD
                self.holders.setdefault((i, WILDCARD), []).append(at)
        return at


#: What stands for a word that differs within a template.
WILDCARD = "<*>"
#: Words of a text that lead to its leaf, after their number.
TREE_DEPTH = 2


def mine_templates(df: DataFrame, text: str = "message", similarity: float = 0.4, known: DataFrame | None = None) -> DataFrame:
    """(signature, template, n, template_id, template_count): masked messages and the template that they are merged into.

    Messages are counted by masked text first. The number of words and the first two lead to a leaf of a tree, which is
    shallow and so bounded in depth; within it distinct signatures are merged greedily, the commonest first, where enough words
    are equal. Rows of a leaf pass sorted and one by one through a task that holds the leaf's templates, not its signatures.
    ``known`` has the templates of earlier batches (template, place), as ``template_state`` gives them: they stand first, and
    what fits them joins them, so mining goes on from batch to batch. The result does not hang on the order of rows.
    """
    return merge_signatures(df.select(S.mask_tokens(F.coalesce(F.col(text), F.lit(""))).alias("signature")), similarity, known)


def merge_signatures(df: DataFrame, similarity: float = 0.4, known: DataFrame | None = None) -> DataFrame:
    """As ``mine_templates``, of messages that are masked already (``signature``)."""
    masked = df.groupBy("signature").agg(F.count("*").alias("n"))
    split = lambda c: F.split(F.trim(c), r"\s+")
    rows = masked.select("signature", "n", F.lit(None).cast("long").alias("place"), split("signature").alias("words"))
    if known is not None:
        rows = rows.unionByName(known.select(F.col("template").alias("signature"), F.lit(0).cast("long").alias("n"), F.col("place").cast("long").alias("place"), split("template").alias("words")))
    shaped = rows.select("signature", "n", "place", F.size("words").alias("size"), F.concat_ws(" ", F.slice("words", 1, TREE_DEPTH)).alias("head"))
    order = ["size", "head", F.asc_nulls_last("place"), F.desc("n"), "signature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaf, held = None, TemplateLeaf(similarity), []

        def done() -> pd.DataFrame:
            return pd.DataFrame([(s, " ".join(leaf.templates[i]), n) for s, i, n in held], columns=["signature", "template", "n"])

        for batch in batches:
            for signature, n, place, size, head in batch.itertuples(index=False, name=None):
                if (size, head) != now:
                    if held:
                        yield done()
                    now, leaf, held = (size, head), TemplateLeaf(similarity), []
                tokens = signature.split()
                if not pd.isna(place):
                    leaf.add(tokens)
                else:
                    held.append((signature, leaf.join(tokens), n))
        if held:
            yield done()

    merged = shaped.repartition("size", "head").sortWithinPartitions(*order).mapInPandas(run, "signature string, template string, n long")
    total = Window.partitionBy("template")
    return merged.withColumns({"template_id": F.substring(F.sha2("template", 256), 1, 12), "template_count": F.sum("n").over(total)})


def template_state(mined: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(template, place): what ``mine_templates`` needs to go on: its templates, the commonest first, after those known before.

    Known templates that new signatures have widened are kept in both forms.
    """
    new = mined.groupBy("template").agg(F.sum("n").alias("_n"))
    if known is None:
        return new.select("template", (-F.col("_n")).alias("place"))
    last = known.agg(F.coalesce(F.max("place"), F.lit(0)).alias("_last"))
    later = new.join(known.select("template"), "template", "left_anti")
    top = later.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_top"))
    return known.select("template", "place").unionByName(later.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(top)).select("template", (F.col("_last") + 1 + F.col("_top") - F.col("_n")).alias("place")))


def templated(df: DataFrame, mined: DataFrame, text: str = "message") -> DataFrame:
    """``df`` with the ``template`` and ``template_id`` of every message; joined by the masked text, whose frequent values are split
    by Spark where they are skewed (E7)."""
    signature = S.mask_tokens(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("signature", signature).join(small(mined.select("signature", "template", "template_id")), "signature").drop("signature")


def quantile_edges(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, edges): distinct quantile edges of each feature, exact and interpolated."""
    points = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("m")).select("m.*")
    return long.filter("x is not null").groupBy("feature").agg(F.array_distinct(F.percentile("x", points)).alias("edges"))


def drift_psi(baseline: DataFrame, current: DataFrame, features: list[str], bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """PSI and KL divergence of each feature on quantile bins of the baseline (G9): values outside are left out."""
    edges = quantile_edges(baseline, features, bins)

    def shares(df: DataFrame, name: str) -> DataFrame:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("m")).select("m.*")
        held = long.join(F.broadcast(edges), "feature").filter((F.col("x") >= F.col("edges")[0]) & (F.col("x") <= F.array_max("edges")))
        place = F.least(F.size(F.filter("edges", lambda e: e <= F.col("x"))), F.size("edges") - 1)
        counts = held.groupBy("feature", place.alias("bin")).agg(F.count("*").alias("n"))
        return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).drop("n")

    both = shares(baseline, "p").join(shares(current, "q"), ["feature", "bin"], "full")
    p, q = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(epsilon)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(epsilon))
    sums = both.groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"), F.sum(q * F.ln(q / p)).alias("kl"))
    level = first_match([(F.col("psi") >= 0.25, F.lit("critical")), (F.col("psi") >= 0.1, F.lit("warning"))], F.lit("ok"))
    return sums.withColumn("level", level)


def score_psi(reference: DataFrame, current: DataFrame, score: str = "score", bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """PSI of two score distributions on equal bins over [0, 1], ``epsilon`` added to each share."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias(name))

    all_bins = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = all_bins.join(counts(reference, "a"), "bin", "left").join(counts(current, "b"), "bin", "left").fillna(0)
    over = Window.partitionBy(F.lit(0))
    p, q = F.col("a") / F.sum("a").over(over) + epsilon, F.col("b") / F.sum("b").over(over) + epsilon
    one = both.select(p.alias("p"), q.alias("q")).agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return one.withColumn("level", first_match([(F.col("psi") >= 0.25, F.lit("critical")), (F.col("psi") >= 0.1, F.lit("warning"))], F.lit("ok")))


def symmetric_drift(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """Symmetric KL divergence, mean shift and a drift flag of each feature on equal-width bins."""
    melt = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("m")).select("m.*", F.lit(side).alias("side"))
    long = melt(reference, 0).unionByName(melt(current, 1))
    span = long.groupBy("feature").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg(F.when(F.col("side") == 0, F.col("x"))).alias("m0"), F.avg(F.when(F.col("side") == 1, F.col("x"))).alias("m1"), F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = long.join(F.broadcast(span), "feature").groupBy("feature", place.alias("bin"), "n0", "n1", "m0", "m1").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    p, q = F.col("a") / F.col("n0") + epsilon, F.col("b") / F.col("n1") + epsilon
    sums = counts.groupBy("feature", "m0", "m1").agg((F.sum(p * F.ln(p / q)) / 2 + F.sum(q * F.ln(q / p)) / 2).alias("kl"))
    return sums.select("feature", "kl", F.abs(F.col("m1") - F.col("m0")).alias("mean_shift"), (F.col("kl") > 0.1).alias("drift"))


def calibrate_thresholds(df: DataFrame, label: str = "label", score: str = "score", steps: int = 45) -> DataFrame:
    """The best pair of thresholds on a grid (G13): scores are counted by hundredth and label first, and the grid is
    crossed with these hundred rows, never with the data.

    Value: .40 recall + .25 (1 - miss) + .20 precision + .10 (1 - monitored share) + .05 (1 - false alarm).
    """
    spark = df.sparkSession
    hist = df.groupBy(F.least(F.floor(F.col(score) * 100), F.lit(99)).cast("int").alias("bin")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    one = spark.range(steps).select((F.col("id") + 10).cast("int").alias("low"))
    grid = one.crossJoin(spark.range(steps).select((F.col("id") + 50).cast("int").alias("high"))).filter("low < high")
    cells = grid.join(F.broadcast(hist), F.lit(True))
    sums = cells.groupBy("low", "high").agg(
        F.sum(F.when(F.col("bin") >= F.col("low"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("bin") >= F.col("low"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("bin") >= F.col("low")) & (F.col("bin") < F.col("high")), F.col("pos") + F.col("neg")).otherwise(0)).alias("mid"), F.sum("pos").alias("P"), F.sum("neg").alias("N"),
    )
    recall, alarm = F.try_divide("tp", "P"), F.try_divide("fp", "N")
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    value = 0.40 * recall + 0.25 * recall + 0.20 * precision + 0.10 * (1 - F.col("mid") / (F.col("P") + F.col("N"))) + 0.05 * (1 - alarm)
    best = sums.withColumn("value", F.round(value, 9)).orderBy(F.desc("value"), "low", "high").limit(1)
    return best.select((F.col("low") / 100).alias("suspicious"), (F.col("high") / 100).alias("anomalous"), "value")


def best_f1_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The score from which on flagging gives the best F1 (G14), over distinct scores."""
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("hits"), F.count("*").alias("all"))
    curve = descending_sums(by, "threshold", {"tp": "hits", "flagged": "all"})
    total = by.agg(F.sum("hits").alias("positives"))
    f1 = F.try_divide(2 * F.col("tp"), F.col("flagged") + F.col("positives"))
    return curve.crossJoin(F.broadcast(total)).select("threshold", F.round(f1, 9).alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def percentile_thresholds(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """suspicious: 95th percentile of normal scores, anomalous: median of attack scores; moved apart if they cross."""
    one = df.agg(F.percentile(F.when(F.col(label) == 0, F.col(score)), F.lit(0.95)).alias("s"), F.percentile(F.when(F.col(label) == 1, F.col(score)), F.lit(0.5)).alias("a"))
    crossed = F.col("s") >= F.col("a")
    middle = (F.col("s") + F.col("a")) / 2
    return one.select(F.when(crossed, middle - 0.05).otherwise(F.col("s")).alias("suspicious"), F.when(crossed, middle + 0.05).otherwise(F.col("a")).alias("anomalous"))


def pseudo_labels(df: DataFrame, score: str = "score", high: float = 0.80, low: float = 0.20) -> DataFrame:
    """Rows of clear scores with label 1 or 0, the others left out."""
    return df.withColumn("pseudo_label", F.when(F.col(score) >= high, 1).when(F.col(score) <= low, 0)).filter("pseudo_label is not null")


def replay_buffer(df: DataFrame, as_of_us: Column, hours: int = 24, limit: int = 50_000) -> DataFrame:
    """The newest labelled rows of the last hours."""
    recent = pseudo_labels(df).filter((F.col("us") > as_of_us - hours * 3_600_000_000) & (F.col("us") <= as_of_us))
    return recent.orderBy(F.desc("us"), F.desc("event_id")).limit(limit)


def in_bins(x: Column, edges: list[float]) -> Column:
    """Number of the bin of ascending edges that a value falls in, the last closed; null outside."""
    cases = [((x >= a) & ((x < b) if i < len(edges) - 2 else (x <= b)), F.lit(i)) for i, (a, b) in enumerate(pairwise(edges))]
    return first_match(cases, F.lit(None).cast("int"))
