"""Investigations (inventory H): all alerts at once, one output row each.

Each operator is an aggregate over the rows of an alert's entity in the time before it, met by the bucketed interval
join, so no query is made for a single alert and no entity's whole history is paired with its alerts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.normalize import first_match
from logloom.operators.joins import interval_join, small
from logloom.operators.sweeps import appearances, occurrences, present_values, running_totals, trailing_rows

HOUR = 3_600_000_000

# The rule pack (H3). Name, severity, words of which one must be in the text, look-back filter (SQL over
# history rows), measure (count or the column whose distinct values count), least measure to exceed, how both combine.
RULES = (
    ("brute-force-login", 3, ("login failed", "authentication failure", "login invalid"), "message ilike '%fail%password%'", "count", 5, "or"),
    ("dns-tunnel", 3, ("dns tunnel", "nxdomain flood", "txt record exfil"), "message ilike '%dns%'", "count", 20, "or"),
    ("policy-bypass", 3, ("policy bypass", "deny then allow", "access-list violated"), "message ilike '%drop%'", "count", 0, "or"),
    ("ips-exploit", 4, ("ips signature", "exploit detected", "attack signature hit"), "message ilike '%ips%signature%'", "count", 0, "or"),
    ("snmp-sweep", 2, ("snmp community", "snmp get", "community mismatch"), "dst_port = 161", "dst_ip", 5, "or"),
    ("bgp-hijack", 4, ("bgp update unexpected", "bgp prefix hijack", "invalid as_path"), "message ilike '%bgp%update%'", "count", 0, "or"),
    ("defense-evasion", 4, ("defense-evasion",), "tactic = 'defense-evasion'", "count", 3, "and"),
    ("attack-category", 3, (), "event_type = 'error'", "count", 5, "and"),
    ("initial-access", 4, ("initial-access",), "tactic = 'initial-access'", "count", 0, "and"),
    ("lateral-movement", 3, ("lateral",), "message ilike '%lateral%'", "count", 3, "and"),
    ("privilege-escalation", 3, ("sudo", "root"), "message ilike '%sudo%'", "count", 0, "and"),
    ("smb-fan-out", 3, ("smb lateral", "smb tree connect", "admin$ share"), "dst_port = 445", "dst_ip", 3, "or"),
)


def _real(key: str) -> Column:
    """Whether an entity is none of the placeholders, which have no history of their own."""
    return F.col(key).isNotNull() & ~F.col(key).isin("", "unknown", "0.0.0.0")


def entity_history(alerts: DataFrame, facts: DataFrame, key: str, before_us: int, columns: list[str]) -> DataFrame:
    """(event_id, us, key) of each alert with each row of its entity in the time before it.

    Placeholder entities (null, empty, unknown, 0.0.0.0) have no history of their own and are left out.
    """
    real = _real(key)
    own = alerts.select("event_id", "us", key).filter(real)
    # columns may be names or expressions; the alert's own columns keep their names
    return interval_join(own, facts.select(key, F.col("us").alias("fact_us"), *[F.col(c).alias(f"fact_{c}") for c in columns if c != key]).filter(real), [key], "us", "fact_us", before_us)


def rule_hits(alerts: DataFrame, facts: DataFrame, key: str = "host", minutes: int = 15, rules=RULES, text: str = "message") -> DataFrame:
    """Per alert: names of the rules that hit, their number, greatest severity and whether to take the fast path (H2).

    The measures are running totals of what enters and leaves the look-back: no alert is paired with the rows before
    it, and rows that fit no rule's filter are left out at once.
    """
    span = minutes * 60_000_000
    real = _real(key)
    flagged = facts.filter(real).select(key, "us", "dst_ip", *[F.coalesce(F.expr(rule[3]), F.lit(False)).cast("int").alias(f"r{i}") for i, rule in enumerate(rules)])
    kept = flagged.filter(reduce(lambda a, b: a | b, [F.col(f"r{i}") == 1 for i in range(len(rules))]))
    counted = [i for i, rule in enumerate(rules) if rule[4] == "count"]
    both = kept.groupBy(key, "us").agg(*[F.sum(f"r{i}").alias(f"m{i}") for i in counted])
    ends = F.explode(F.array(*[F.struct((F.col("us") + shift).alias("at"), *[(sign * F.col(f"m{i}")).alias(f"m{i}") for i in counted]) for shift, sign in ((0, 1), (span + 1, -1))]))
    changes = [both.select(key, ends.alias("_c")).select(key, "_c.*")] if counted else []
    changes += [appearances(flagged.filter(F.col(f"r{i}") == 1), key, rule[4], "us", span, f"m{i}") for i, rule in enumerate(rules) if rule[4] != "count"]
    counts = running_totals(alerts.filter(real), key, "us", changes, span)
    out = alerts.join(counts, "event_id", "left")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = []
    for i, (name, severity, words, _, _, least, how) in enumerate(rules):
        over = F.coalesce(F.col(f"m{i}") > least, F.lit(False))
        said = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) if words else None
        good = over if said is None else (said | over if how == "or" else said & over)
        hits.append(F.when(good, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    out = out.withColumn("_hits", found)
    return out.select("event_id", F.array_sort(F.transform("_hits", lambda x: x["rule"])).alias("rules"), F.size("_hits").alias("hit_count"), F.coalesce(F.array_max(F.transform("_hits", lambda x: x["severity"])), F.lit(0)).alias("max_severity")).withColumn("fast_path", F.col("max_severity") >= 3)


def spc_check(alerts: DataFrame, facts: DataFrame, baseline: DataFrame, key: str = "host", limit: float = 3.0) -> DataFrame:
    """z of an entity's rows in the last hour against its baseline, and whether that is out of control (H4)."""
    counts = running_totals(alerts.filter(_real(key)), key, "us", [occurrences(facts.filter(_real(key)), key, "us", HOUR, "observed")], HOUR)
    out = alerts.select("event_id", key).join(counts, "event_id", "left").join(small(baseline.select(key, "mean", "std")), key, "left")
    observed = F.coalesce("observed", F.lit(0))
    z = F.when(F.coalesce(F.col("std"), F.lit(0.0)) > 0, (observed - F.col("mean")) / F.col("std")).otherwise(0.0)
    return out.select("event_id", observed.alias("observed"), z.alias("z")).withColumn("is_anomaly", F.col("z") > limit)


def temporal_features(alerts: DataFrame, facts: DataFrame, hours: int = 24, related: int = 50) -> DataFrame:
    """High-scored rows of the same host and address before each alert: count, sources, tactics, mean score and ids of
    rows related by the host and either the address or the user (H5).

    No alert is paired with the rows before it: rows enter and leave sums in the order of time, by host and address and by
    host and user, and only the newest are held. The ids of both are put together, never by an OR join.
    """
    high = facts.filter("score >= 0.39").select("event_id", "host", "src_ip", "usr", "us", "source", "tactic", "score")
    own, span = alerts.select("event_id", "host", "src_ip", "usr", "us"), hours * HOUR
    by_ip = trailing_rows(own.drop("usr"), high.drop("usr"), ["host", "src_ip"], "us", ["source", "tactic"], "score", span, "event_id", related)
    by_user = trailing_rows(own.drop("src_ip"), high.drop("src_ip", "source", "tactic"), ["host", "usr"], "us", [], "score", span, "event_id", related)
    newest = F.flatten(F.collect_list("newest")).alias
    sums = by_ip.groupBy("event_id").agg(F.sum("rows").alias("escalations"), F.max("n_source").alias("sources"), F.max("n_tactic").alias("tactics"), F.max("mean").alias("mean_score"), newest("_ip"))
    ids = by_user.groupBy("event_id").agg(newest("_user"))
    out = alerts.select("event_id").join(sums, "event_id", "left").join(ids, "event_id", "left")
    none = F.array().cast(dict(sums.dtypes)["_ip"])
    both = F.sort_array(F.array_union(F.coalesce("_ip", none), F.coalesce("_user", none)), asc=False)
    return out.select("event_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("escalations", "sources", "tactics")], F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.sort_array(F.transform(F.slice(both, 1, related), lambda x: x["id"])).alias("related"))


def graph_features(alerts: DataFrame, flows: DataFrame, ioc: DataFrame, hours: int = 24) -> DataFrame:
    """Counts around each alert's address and host in the flows before it, and scores of lateral movement and of
    command and control (H6). Distinct counts are running totals of values that appear and pass, not pairs."""
    span = hours * HOUR
    bad = small(ioc.select(F.col("value").alias("dst_ip")).distinct())
    of_ip, of_host = flows.filter(_real("src_ip")), flows.filter(_real("host"))
    changes = [
        appearances(of_ip, "src_ip", "dst_ip", "us", span, "destinations"),
        appearances(of_ip, "src_ip", "host", "us", span, "hops"),
        appearances(of_ip.join(bad, "dst_ip", "left_semi"), "src_ip", "dst_ip", "us", span, "bad"),
        occurrences(of_ip.filter("score >= 0.95"), "src_ip", "us", span, "escalations"),
    ]
    a = running_totals(alerts.filter(_real("src_ip")), "src_ip", "us", changes, span)
    b = running_totals(alerts.filter(_real("host")), "host", "us", [appearances(of_host, "host", "src_ip", "us", span, "host_sources")], span)
    a = a.select("event_id", "destinations", "hops", (F.col("bad") > 0).cast("int").alias("ioc_neighbor"), "escalations")
    out = alerts.select("event_id").join(a, "event_id", "left").join(b, "event_id", "left").fillna(0)
    lateral = F.least(F.lit(1.0), F.col("hops") / 10)
    c2 = F.when((F.col("destinations") >= 3) & (F.col("hops") >= 2), F.least(F.lit(1.0), F.col("destinations") / 10 * (1 + F.col("ioc_neighbor")))).otherwise(0.0)
    return out.withColumns({"lateral": lateral, "c2": c2})


def uuid_v5(namespace: str, name: Column) -> Column:
    """UUID version 5 of a name in a namespace (32 hex digits), as an expression (A4, H7)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def campaigns(alerts: DataFrame, facts: DataFrame, hours: int = 24, least: float = 0.70, most_hosts: int = 20) -> DataFrame:
    """Whether an alert's address has high scores on two hosts and with two tactics at least, with the hosts (H7).

    Hosts and tactics are told by when they appear and pass, not by pairs of an alert and the rows before it.
    """
    real = _real("src_ip")
    own = alerts.filter(real).select("event_id", "src_ip", "us").distinct()
    high = facts.filter(real & (F.col("score") >= least)).select("src_ip", "us", "host", "tactic")
    sums = present_values(own, high, "src_ip", "us", ["host", "tactic"], hours * HOUR, "event_id", most_hosts).toDF("event_id", "src_ip", "hosts", "tactics", "host_list")
    is_campaign = (F.col("hosts") >= 2) & (F.col("tactics") >= 2)
    name = uuid_v5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat_ws("_", "src_ip", F.lit(f"{hours}h")))
    return sums.select("event_id", "hosts", "tactics", "host_list", is_campaign.alias("is_campaign"), F.when(is_campaign, name).alias("campaign_id"))


def trigger_flags(df: DataFrame, text: str = "message") -> Column:
    """Array of the flags that an alert raises: words in its text, indicator, off hours, disagreement (H8)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = {"template_auth": "auth|login|password|credential", "template_lateral": "lateral|smb|rdp|remote", "template_user_created": "user_created|new_user|account", "template_priv_escalation": "priv|escalat|sudo", "template_data_exfil": "exfil|upload|transfer", "template_port_scan": "scan|port|recon|discovery", "outbound": "outbound|c2|beacon"}
    flags = [F.when(low.rlike(p), F.lit(name)) for name, p in words.items()]
    flags += [F.when(F.col("off_hours") == 1, F.lit("off_hours")), F.when(F.col("ioc_match") == 1, F.lit("known_malicious_ip")), F.when(F.col("score_std") > 0.3, F.lit("std_dev_high")), F.when(F.col("score2") > 0.7, F.lit("ae_high"))]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def mitre_match(alerts: DataFrame, rules: DataFrame, score: str = "score") -> DataFrame:
    """Technique rules that share a flag with the alert and whose threshold its score meets, by priority, 25 at most;
    5 by score alone for alerts without flags. The alert's own tactic is added if no rule has it (H8).

    ``rules`` (rule_id, priority, triggers, threshold, technique, tactic) is a small table.
    """
    fits = (F.col(score) >= F.col("threshold")) & ((F.size("flags") == 0) | F.arrays_overlap("flags", "triggers"))
    met = alerts.select("event_id", "flags", score).join(small(rules), fits)
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("priority", "rule_id"))
    kept = met.withColumn("_place", place).filter(F.col("_place") <= F.when(F.size("flags") == 0, 5).otherwise(25))
    sums = kept.groupBy("event_id").agg(F.sort_array(F.collect_set("tactic")).alias("_tactics"), F.count("*").alias("_n"))
    out = alerts.select("event_id", "tactic").join(sums, "event_id", "left")
    tactics, n = F.coalesce("_tactics", F.array().cast("array<string>")), F.coalesce("_n", F.lit(0))
    extra = (F.coalesce("tactic", F.lit("")) != "") & ~F.array_contains(tactics, F.coalesce("tactic", F.lit("")))
    joined = F.sort_array(F.when(extra, F.array_union(tactics, F.array("tactic"))).otherwise(tactics))
    return out.select("event_id", joined.alias("tactics"), (n + extra.cast("int")).alias("matches"), F.size(F.filter(joined, lambda t: t != "")).alias("tactic_breadth"))


def similarity_features(matches: DataFrame) -> DataFrame:
    """From nearest neighbours (query_id, distance, label): nearest distance, neighbours within .3, .4 and .5 and the
    share of labelled attacks among those within .5 (H9)."""
    d = F.col("distance")
    return matches.groupBy("query_id").agg(F.min("distance").alias("nearest"), F.count_if(d < 0.3).alias("within_3"), F.count_if(d < 0.4).alias("within_4"), F.count_if(d < 0.5).alias("within_5"), F.coalesce(F.avg(F.when(d < 0.5, (F.col("label") == 1).cast("double"))), F.lit(0.0)).alias("label_confidence"))


# Weights and caps of the heuristic score. Features without a cap are clipped to 0..1.
WEIGHTS = {
    "adjusted_score": 0.38, "base_score": 0.10, "entity_risk": 0.05, "ioc_boost": 0.06, "off_hours_boost": 0.01,
    "distinct_categories": 0.01, "event_count": 0.01, "correlated_alert_count": 0.01, "template_risk": 0.01,
    "graph_unique_destinations": 0.02, "graph_unique_src_ips": 0.01, "graph_has_ioc_neighbor": 0.04, "graph_hop_count": 0.02,
    "graph_high_risk_neighbors": 0.02, "graph_escalation_count": 0.02, "graph_lateral_movement_score": 0.03, "graph_c2_candidate_score": 0.03,
    "temporal_escalation_count": 0.04, "temporal_unique_categories": 0.02, "temporal_tactic_diversity": 0.02, "temporal_mean_score": 0.03,
    "similarity_attack_embed_dist": 0.03, "similarity_historical_dist": 0.02, "similarity_log_embed_matches": 0.01, "similarity_confirmed_neighbor_count": 0.02,
    "similarity_min_confirmed_dist": 0.01, "similarity_false_positive_count": -0.02, "similarity_label_confidence": 0.02,
    "mitre_match_count": 0.02, "mitre_tactic_breadth": 0.02, "campaign_host_count": 0.03, "campaign_tactic_count": 0.02,
    "sigma_hit_count": 0.04, "sigma_max_severity": 0.03, "spc_z_score": 0.03, "spc_is_anomaly": 0.03, "ae_score": 0.06,
    "kill_chain_stage": 0.04, "kill_chain_velocity": 0.03, "entity_event_rate": 0.02,
}
CAPS = {
    "sigma_hit_count": 5, "temporal_escalation_count": 20, "graph_escalation_count": 20, "graph_unique_destinations": 50, "graph_unique_src_ips": 50,
    "graph_hop_count": 10, "graph_high_risk_neighbors": 10, "temporal_unique_categories": 10, "mitre_match_count": 10, "similarity_confirmed_neighbor_count": 10,
    "similarity_false_positive_count": 10, "similarity_log_embed_matches": 20, "campaign_host_count": 20, "campaign_tactic_count": 10, "event_count": 1000,
    "correlated_alert_count": 50, "spc_z_score": 10, "kill_chain_stage": 5, "kill_chain_velocity": 5, "entity_event_rate": 100,
}


# The features of an investigation in order.
FEATURE_ORDER = (
    "adjusted_score", "base_score", "entity_risk", "ioc_boost", "temporal_boost", "destination_risk", "off_hours_boost", "high_severity_count", "medium_severity_count", "distinct_categories", "event_count", "correlated_alert_count", "template_risk",
    "graph_unique_destinations", "graph_unique_src_ips", "graph_has_ioc_neighbor", "graph_hop_count", "graph_high_risk_neighbors", "graph_escalation_count", "graph_lateral_movement_score", "graph_c2_candidate_score",
    "temporal_escalation_count", "temporal_unique_categories", "temporal_tactic_diversity", "temporal_mean_score",
    "similarity_attack_embed_dist", "similarity_historical_dist", "similarity_log_embed_matches", "similarity_confirmed_neighbor_count", "similarity_min_confirmed_dist", "similarity_false_positive_count", "similarity_label_confidence",
    "mitre_match_count", "mitre_tactic_breadth", "campaign_host_count", "campaign_tactic_count", "sigma_hit_count", "sigma_max_severity",
    "spc_z_score", "spc_is_anomaly", "spc_baseline_mean", "spc_baseline_stddev", "ae_score", "kill_chain_stage", "kill_chain_velocity", "entity_event_rate",
)


def hunter_vector(df: DataFrame, names: list[str] | None = None) -> Column:
    """The investigation's features in their fixed order, missing ones 0."""
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0) for n in names or FEATURE_ORDER])


def heuristic_score(df: DataFrame, weights: dict = WEIGHTS, caps: dict = CAPS) -> Column:
    """Weighted sum of capped features, clipped; distances with a positive weight count inverted.

    A feature that ``df`` lacks counts as 0.
    """
    total = F.lit(0.0)
    for name, weight in weights.items():
        raw = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
        x = F.least(raw / caps[name], F.lit(1.0)) if name in caps else F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
        total = total + weight * (1 - x if "dist" in name and weight > 0 and name.endswith("dist") else x)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def finding_type(hits: Column, max_severity: Column, campaign: Column, anomaly: Column, triage: Column, known_tactic: Column, score: Column) -> Column:
    """An ordered decision table over the signals."""
    has, strong = hits > 0, triage >= 0.89
    confirmed, odd = F.lit("CONFIRMED_ATTACK"), F.lit("BEHAVIOURAL_ANOMALY")
    return first_match([
        (max_severity >= 3, confirmed),
        (campaign, F.lit("ACTIVE_CAMPAIGN")),
        (has & anomaly, confirmed),
        (has & strong, confirmed),
        (strong & (anomaly | known_tactic), confirmed),
        (has | strong, odd),
        (anomaly & (score >= 0.42), confirmed),
        (anomaly, F.lit("ANOMALOUS_PATTERN")),
        (score >= 0.50, confirmed),
        (score >= 0.33, odd),
    ], F.lit("NORMAL_BEHAVIOUR"))


def attack_graph(df: DataFrame) -> Column:
    """Struct of nodes, edges, number of signals and density of an investigation's graph.

    Needs host, src_ip, usr and the signals hit_count, is_campaign, is_anomaly and ioc_match.
    """
    node = lambda kind, c: F.when(c.isNotNull(), F.struct(F.concat(F.lit(f"{kind}:"), c.cast("string")).alias("id"), F.lit(kind).alias("kind")))
    flag = lambda name, cond: F.when(cond, F.struct(F.lit(f"signal:{name}").alias("id"), F.lit("signal").alias("kind")))
    entities = [node("host", F.col("host")), node("ip", F.col("src_ip")), node("user", F.col("usr"))]
    signals = [flag("rules", F.col("hit_count") > 0), flag("campaign", F.col("is_campaign")), flag("volume", F.col("is_anomaly")), flag("indicator", F.col("ioc_match") == 1)]
    present = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    fired = F.size(present(signals))
    edges = F.transform(present([*entities[1:], *signals]), lambda x: F.struct(x["id"].alias("from"), F.concat(F.lit("host:"), F.col("host")).alias("to")))
    density = first_match([(fired >= 3, F.lit("rich")), (fired >= 1, F.lit("medium"))], F.lit("sparse"))
    return F.struct(present([*entities, *signals]).alias("nodes"), edges.alias("edges"), fired.alias("signals"), density.alias("density"))


def graph_text(graph: Column) -> Column:
    """A graph's edges as lines of a diagram."""
    return F.array_join(F.transform(graph["edges"], lambda e: F.concat(e["from"], F.lit(" --> "), e["to"])), "\n")


def fast_path_verdicts(df: DataFrame) -> DataFrame:
    """Alerts with a severe rule, confirmed at once."""
    return df.filter("fast_path").select("event_id", F.lit("CONFIRMED_ATTACK").alias("finding_type"), F.lit(0.95).alias("confidence"))


def tactic_arrays(tactics: Column, related: Column, most: int = 50) -> Column:
    return F.struct(F.array_distinct(tactics).alias("tactics"), F.slice(related, 1, most).alias("correlated"))


def training_rows(df: DataFrame, least: float = 0.20) -> DataFrame:
    """Rows to train on with label 1 for attacks and campaigns, 0 for normal behaviour."""
    label = F.when(F.col("finding_type").isin("CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN"), 1).when(F.col("finding_type") == "NORMAL_BEHAVIOUR", 0)
    return df.filter(~F.col("fast_path") & (F.col("score") >= least)).withColumn("label", label).filter("label is not null")


def training_set(rows: DataFrame, limit: int = 50_000, least: int = 100, negatives: float = 0.10) -> DataFrame:
    """The newest training rows, or none if there are too few rows or negatives."""
    newest = rows.orderBy(F.desc("us"), F.desc("event_id")).limit(limit)
    good = newest.agg(((F.count("*") >= least) & (F.avg((F.col("label") == 0).cast("double")) >= negatives)).alias("_good"))
    return newest.crossJoin(F.broadcast(good)).filter("_good").drop("_good")
