"""Joins and enrichment (inventory D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.windows import latest_per_key

#: Lookup tables are broadcast up to so many rows, of a few hundred bytes each; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more rows than ``bound``.

    Only ``bound + 1`` rows are looked at to tell.
    """
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before: int, after: int = 0, how: str = "inner") -> DataFrame:
    """Rows of ``right`` with the same keys and ``right_at`` in [left_at - before, left_at + after].

    Both sides get a bucket of the interval's length; a left row is repeated for each bucket that its interval touches
    (two or three), and the join is on keys and bucket. So a key's history is not paired as a whole, and a hot key is
    spread over its buckets. ``how`` is inner or left; left rows must differ for left joins.
    """
    width = max(before + after, 1)
    bucket = lambda c: F.floor(c / width).cast("long")
    touched = F.sequence(bucket(F.col(left_at) - before), bucket(F.col(left_at) + after))
    wide = left.withColumn("_bucket", F.explode(touched))
    dealt = right.withColumnRenamed(right_at, "_right_at").withColumn("_bucket", bucket(F.col("_right_at")))
    met = wide.join(dealt, [*keys, "_bucket"]).filter(F.col("_right_at").between(F.col(left_at) - before, F.col(left_at) + after)).drop("_bucket").withColumnRenamed("_right_at", f"{right_at}_right" if right_at in left.columns else right_at)
    if how == "inner":
        return met
    return left.join(met, left.columns, "left")


def ioc_match(df: DataFrame, ioc: DataFrame, as_of: Column) -> DataFrame:
    """``ioc_match`` and ``ioc_confidence`` of the first unexpired indicator among source and destination."""
    live = small(ioc.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).groupBy(F.lower(F.trim("value")).alias("_ioc")).agg(F.max("confidence").alias("_confidence")))
    out = df
    for side in ("src_ip", "dst_ip"):
        out = out.join(live.toDF(f"_{side}", f"_{side}_confidence"), F.lower(F.trim(side)) == F.col(f"_{side}"), "left")
    found = F.coalesce("_src_ip_confidence", "_dst_ip_confidence")
    return out.withColumns({"ioc_match": found.isNotNull().cast("int"), "ioc_confidence": F.coalesce(found, F.lit(0))}).drop("_src_ip", "_src_ip_confidence", "_dst_ip", "_dst_ip_confidence")


def allowlist(df: DataFrame, allow: DataFrame, kinds: dict[str, str], key: str = "event_id") -> DataFrame:
    """``allowed``: whether any entity of a row is on the active list (D2). ``kinds`` maps entry types to columns."""
    entities = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in kinds.items()]))
    hits = df.select(key, entities.alias("e")).select(key, "e.kind", "e.value").join(small(allow.filter("active").select("kind", "value")), ["kind", "value"], "left_semi").select(key).distinct().withColumn("allowed", F.lit(True))
    return df.join(hits, key, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def ioc_flows(alerts: DataFrame, net: DataFrame, ioc: DataFrame, hours: int = 72) -> DataFrame:
    """Flows from an alert's source to a known-bad destination in the time before it (D3)."""
    bad = net.join(small(ioc.select(F.col("value").alias("dst_ip"))), "dst_ip", "left_semi")
    return interval_join(alerts, bad.select("src_ip", F.col("us").alias("flow_us"), F.col("dst_ip").alias("bad_ip"), F.col("event_id").alias("flow_id")), ["src_ip"], "us", "flow_us", hours * 3_600_000_000)


def alert_scores(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Events of severity 2 and more with the latest score of each."""
    latest = scores.groupBy("event_id").agg(F.max_by("score", "scored_us").alias("latest_score"))
    return events.filter("severity >= 2").join(latest, "event_id", "left")


def investigation_list(investigations: DataFrame, verifications: DataFrame) -> DataFrame:
    """Investigations with the latest verification of each."""
    latest = latest_per_key(verifications, ["investigation_id"], "verified_us", "verification_id")
    return investigations.join(latest, "investigation_id", "left")


def asset_multiplier(df: DataFrame, assets: DataFrame, host: str = "host") -> DataFrame:
    """Multiplier of the first pattern, in pattern order, that a host name is like; 1 if none.

    Patterns are matched against the distinct hosts only, and their result is joined back.
    """
    hosts = df.select(host).distinct()
    met = hosts.join(small(assets), F.ilike(F.col(host), F.col("pattern")))
    first = met.groupBy(host).agg(F.min_by("multiplier", "priority").alias("multiplier"))
    return df.join(first, host, "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))


def threshold_lookup(df: DataFrame, thresholds: DataFrame, topic: str, source: str, suspicious: float = 0.39, anomalous: float = 0.95) -> DataFrame:
    """Thresholds by topic, else by source, else the defaults."""
    t = small(thresholds.select("key", "suspicious", "anomalous"))
    out = df.join(t.toDF("_t", "_ts", "_ta"), F.col(topic) == F.col("_t"), "left").join(t.toDF("_s", "_ss", "_sa"), F.col(source) == F.col("_s"), "left")
    return out.withColumns({"suspicious": F.coalesce("_ts", "_ss", F.lit(suspicious)), "anomalous": F.coalesce("_ta", "_sa", F.lit(anomalous))}).drop("_t", "_ts", "_ta", "_s", "_ss", "_sa")


def feedback_join(scores: DataFrame, labels: DataFrame, entity: str, newest: int = 20) -> DataFrame:
    """The newest labelled scores of each entity."""
    met = scores.join(labels, "event_id")
    return met.withColumn("_place", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("us"), F.desc("event_id")))).filter(F.col("_place") <= newest).drop("_place")


def prior_verdicts(verdicts: DataFrame, investigations: DataFrame, newest: int = 10) -> DataFrame:
    """The newest verdicts on alerts of each entity's investigations."""
    met = verdicts.join(investigations.select("alert_id", "entity").distinct(), "alert_id")
    return met.withColumn("_place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("us"), F.desc("alert_id")))).filter(F.col("_place") <= newest).drop("_place")


def rare_or_ioc_sources(df: DataFrame, ioc: DataFrame, scores: DataFrame, often: int = 50) -> DataFrame:
    """Rows whose source is a known indicator or is not among the often scored ones (D10), by existence flags."""
    common = scores.groupBy("src_ip").agg(F.count("*").alias("_n")).filter(F.col("_n") > often).select("src_ip", F.lit(True).alias("_common"))
    known = small(ioc.select(F.col("value").alias("src_ip")).distinct().withColumn("_known", F.lit(True)))
    flagged = df.join(known, "src_ip", "left").join(common, "src_ip", "left")
    return flagged.filter(F.col("_known").isNotNull() | F.col("_common").isNull()).drop("_known", "_common")


def score_of_investigation(investigations: DataFrame, scores: DataFrame, band: float = 0.01) -> DataFrame:
    """Score of each investigation: of its own event, else the nearest of its host within a band.

    The band join is on host and score bucket of the band's width, so it is an equality join.
    """
    exact = investigations.join(scores.select(F.col("event_id"), F.col("score").alias("exact_score")), "event_id", "left")
    bucket = lambda c: F.floor(c / band).cast("long")
    wanted = exact.filter("exact_score is null").withColumn("_b", F.explode(F.array(bucket(F.col("wanted_score")) - 1, bucket(F.col("wanted_score")), bucket(F.col("wanted_score")) + 1)))
    other = scores.select("host", F.col("score").alias("near_score"), F.col("event_id").alias("near_id")).withColumn("_b", bucket(F.col("near_score")))
    gap = F.abs(F.col("near_score") - F.col("wanted_score"))
    near = wanted.join(other, ["host", "_b"]).filter(gap < band).groupBy("investigation_id").agg(F.min_by("near_score", F.struct(gap, "near_id")).alias("near_score"))
    return exact.join(near, "investigation_id", "left").withColumn("found_score", F.coalesce("exact_score", "near_score")).drop("near_score")


def anchor_cover(alerts: DataFrame, anchors: DataFrame, slack_us: int = 7_200_000_000, newest: int = 10) -> DataFrame:
    """The newest anchors whose windows overlap the time around each alert (D13), met by day."""
    day = 86_400_000_000
    days = lambda a, b: F.explode(F.sequence(F.floor(a / day), F.floor(b / day)))
    mine = alerts.withColumn("_day", days(F.col("us") - slack_us, F.col("us") + slack_us))
    theirs = anchors.withColumn("_day", days(F.col("time_from"), F.col("time_to")))
    met = mine.join(theirs, "_day").filter((F.col("time_from") <= F.col("us") + slack_us) & (F.col("time_to") >= F.col("us") - slack_us)).drop("_day").dropDuplicates(["event_id", "anchor_id"])
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("time_from"), "anchor_id"))
    return met.withColumn("_place", place).filter(F.col("_place") <= newest).drop("_place")


def cross_table_ips(severe: DataFrame, flows: DataFrame) -> DataFrame:
    """Addresses with severe events and flows, and both counts."""
    a = severe.groupBy("src_ip").agg(F.count("*").alias("severe"))
    b = flows.groupBy("src_ip").agg(F.count("*").alias("flows"))
    return a.join(b, "src_ip")


def context_window_events(events: DataFrame, attacks: DataFrame, windows: DataFrame) -> DataFrame:
    """Events that are an attack, or fall into a merged window and share the user or host of an attack."""
    exact = events.join(attacks.select("us", "usr").distinct(), ["us", "usr"], "left_semi").select("event_id").withColumn("role", F.lit("attack"))
    # windows are entered in each hour that they touch, and events meet those of their own hour
    hour = lambda us: F.floor(F.col(us) / 3_600_000_000)
    spans = windows.select("start_us", "end_us", F.explode(F.sequence(hour("start_us"), hour("end_us"))).alias("_hour"))
    inside = events.withColumn("_at", hour("us")).join(spans.distinct(), (F.col("_at") == F.col("_hour")) & F.col("us").between(F.col("start_us"), F.col("end_us")), "left_semi").drop("_at")
    users, hosts = (attacks.select(c).distinct().withColumn(f"_{c}", F.lit(True)) for c in ("usr", "host"))
    near = inside.join(small(users), "usr", "left").join(small(hosts), "host", "left").filter("_usr or _host").select("event_id").join(exact, "event_id", "left_anti").withColumn("role", F.lit("context"))
    return exact.unionByName(near)


def message_lookup(families: list[DataFrame], scores: DataFrame) -> DataFrame:
    """(event_id, text) of several families with the score of each, if any."""
    both = families[0]
    for more in families[1:]:
        both = both.unionByName(more)
    return both.join(scores, "event_id", "left")


def reconcile(sent: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """Sent and found rows of each tag and the loss in percent."""
    a, b = (df.groupBy(tag).agg(F.count("*").alias(n)) for df, n in ((sent, "sent"), (found, "found")))
    both = a.join(b, tag, "full").fillna(0, ["sent", "found"])
    return both.withColumn("loss_pct", F.when(F.col("sent") > 0, (F.col("sent") - F.col("found")) / F.col("sent") * 100).otherwise(0.0))


def new_only(feed: DataFrame, seen: DataFrame, key: str = "event_id") -> DataFrame:
    return feed.join(seen.select(key), key, "left_anti")
