"""Queries of investigations (inventory H) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import investigate as H
from logloom.operators import rollups as R
from logloom.plans.aggregates import SCORED_SQL, bucket_sql, scored
from logloom.plans.joins_plans import HOUR, IOC_SQL, indicators
from logloom.plans.registry import query
from logloom.sources.fixtures import EV_SQL, log_events

ALERTS_SQL = EV_SQL + ", alerts AS (SELECT * FROM logs WHERE score >= 0.6)\n"


def alerts_of(ev):
    return ev.filter("score >= 0.6")


def _rule_sql(what: str = "severity") -> str:
    out = []
    for i, (name, severity, words, where, measure, least, how) in enumerate(H.RULES):
        over = f"coalesce(m{i}, 0) > {least}"
        said = " OR ".join(f"contains(lower(message), '{w}')" for w in words)
        out.append(f"CASE WHEN {over if not words else f'({said}) {how.upper()} {over}'} THEN {severity if what == 'severity' else repr(name)} END")
    return "[" + ", ".join(out) + "]"


MINUTES = 24 * 60
MEASURES_SQL = ", ".join((f"count(*) FILTER (WHERE {w})" if m == "count" else f"count(DISTINCT f.{m}) FILTER (WHERE {w})") .replace("message", "f.message").replace("dst_port", "f.dst_port").replace("tactic", "f.tactic").replace("event_type", "f.event_type") + f" AS m{i}" for i, (_, _, _, w, m, _, _) in enumerate(H.RULES))


@query("h2_rule_hits", ALERTS_SQL + f", m AS (SELECT a.event_id, {MEASURES_SQL} FROM alerts a JOIN logs f ON f.host = a.host AND f.us BETWEEN a.us - {MINUTES * 60_000_000} AND a.us GROUP BY a.event_id), h AS (SELECT event_id, list_filter({_rule_sql()}, lambda x: x IS NOT NULL) AS hits FROM alerts LEFT JOIN m USING (event_id)) SELECT event_id, len(hits)::INT AS hit_count, coalesce(list_max(hits), 0) AS max_severity, coalesce(list_max(hits), 0) >= 3 AS fast_path FROM h")
def h2(spark, d):
    ev = log_events(spark, d)
    return H.rule_hits(alerts_of(ev), ev, minutes=MINUTES).drop("rules")


@query("h4_spc_check", ALERTS_SQL + f", b AS (SELECT host, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS std FROM (SELECT host, {bucket_sql(3600)} AS b, count(*) AS n FROM ev GROUP BY ALL) GROUP BY host), o AS (SELECT a.event_id, count(f.event_id) AS observed FROM alerts a LEFT JOIN ev f ON f.host = a.host AND f.us BETWEEN a.us - {HOUR} AND a.us GROUP BY a.event_id) SELECT event_id, observed, round(CASE WHEN std > 0 THEN (observed - mean) / std ELSE 0 END, 6)::DOUBLE AS z, CASE WHEN std > 0 THEN (observed - mean) / std ELSE 0 END > 3 AS is_anomaly FROM alerts JOIN o USING (event_id) LEFT JOIN b USING (host)")
def h4(spark, d):
    ev = log_events(spark, d)
    return H.spc_check(alerts_of(ev), ev, R.spc_baseline(ev, ["host"], seconds=3600))


@query("h5_temporal_features", ALERTS_SQL + f""", hi AS (SELECT * FROM ev WHERE score >= 0.39), p AS (SELECT a.event_id, f.event_id AS fid, f.us, f.source, f.tactic, f.score, f.src_ip = a.src_ip AS by_ip FROM alerts a JOIN hi f ON f.host = a.host AND (f.src_ip = a.src_ip OR f.usr = a.usr) AND f.us BETWEEN a.us - 240 * {HOUR} AND a.us AND f.event_id <> a.event_id),
s AS (SELECT event_id, count(*) AS n, count(DISTINCT source) AS so, count(DISTINCT tactic) AS ta, avg(score) AS m FROM p WHERE by_ip GROUP BY event_id), r AS (SELECT event_id, list_sort(list(fid)) AS related FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY us DESC, fid DESC) AS rn FROM p) WHERE rn <= 50 GROUP BY event_id)
SELECT event_id, coalesce(n, 0) AS escalations, coalesce(so, 0) AS sources, coalesce(ta, 0) AS tactics, round(coalesce(m, 0) + 1e-9, 6) AS mean_score, coalesce(array_to_string(related, ','), '') AS related FROM alerts LEFT JOIN s USING (event_id) LEFT JOIN r USING (event_id)""")
def h5(spark, d):
    ev = log_events(spark, d)
    return H.temporal_features(alerts_of(ev), ev, hours=240).withColumn("mean_score", F.col("mean_score") + 1e-9).withColumn("related", F.array_join(F.col("related").cast("array<string>"), ","))


@query("h6_graph_features", ALERTS_SQL + IOC_SQL.replace("src_ip AS value", "dst_ip AS value") + f""", x AS (SELECT a.event_id, count(DISTINCT f.dst_ip) AS destinations, count(DISTINCT f.host) AS hops, max((f.dst_ip IN (SELECT value FROM ioc))::INT) AS ioc_neighbor, count(*) FILTER (WHERE f.score >= 0.95) AS escalations FROM alerts a JOIN ev f ON f.src_ip = a.src_ip AND f.us BETWEEN a.us - 240 * {HOUR} AND a.us GROUP BY a.event_id),
y AS (SELECT a.event_id, count(DISTINCT f.src_ip) AS host_sources FROM alerts a JOIN ev f ON f.host = a.host AND f.us BETWEEN a.us - 240 * {HOUR} AND a.us GROUP BY a.event_id)
SELECT *, round(least(1, hops / 10), 6)::DOUBLE AS lateral, round(CASE WHEN destinations >= 3 AND hops >= 2 THEN least(1, destinations / 10 * (1 + ioc_neighbor)) ELSE 0 END, 6)::DOUBLE AS c2 FROM x JOIN y USING (event_id)""")
def h6(spark, d):
    ev = log_events(spark, d)
    bad = ev.filter("user_id % 17 = 0").select(F.col("dst_ip").alias("value")).distinct()
    return H.graph_features(alerts_of(ev), ev, bad, hours=240)


@query("h7_campaigns", ALERTS_SQL + f"SELECT a.event_id, count(DISTINCT f.host) AS hosts, count(DISTINCT f.tactic) AS tactics, array_to_string(list_sort(list(DISTINCT f.host))[1:20], ',') AS host_list, count(DISTINCT f.host) >= 2 AND count(DISTINCT f.tactic) >= 2 AS is_campaign FROM alerts a JOIN ev f ON f.src_ip = a.src_ip AND f.us BETWEEN a.us - 240 * {HOUR} AND a.us AND f.score >= 0.5 GROUP BY a.event_id")
def h7(spark, d):
    ev = log_events(spark, d)
    return H.campaigns(alerts_of(ev), ev, hours=240, least=0.5).drop("campaign_id").withColumn("host_list", F.array_join("host_list", ","))


MITRE_RULES = (("brute_force", 10, "template_auth", 0.3, "T1110", "credential-access"), ("lateral_movement", 20, "template_lateral", 0.3, "T1021", "lateral-movement"), ("c2_traffic", 30, "outbound", 0.5, "T1071", "command-and-control"), ("data_exfil", 60, "template_data_exfil", 0.5, "T1041", "exfiltration"), ("network_recon", 80, "template_port_scan", 0.6, "T1046", "discovery"), ("model_disagreement", 90, "std_dev_high", 0.35, "UNKNOWN_TTP", ""))


@query("h8_mitre_match", ALERTS_SQL + """, f AS (SELECT *, list_filter([CASE WHEN regexp_matches(lower(message), 'auth|login|password|credential') THEN 'template_auth' END, CASE WHEN regexp_matches(lower(message), 'lateral|smb|rdp|remote') THEN 'template_lateral' END, CASE WHEN regexp_matches(lower(message), 'user_created|new_user|account') THEN 'template_user_created' END, CASE WHEN regexp_matches(lower(message), 'priv|escalat|sudo') THEN 'template_priv_escalation' END, CASE WHEN regexp_matches(lower(message), 'exfil|upload|transfer') THEN 'template_data_exfil' END, CASE WHEN regexp_matches(lower(message), 'scan|port|recon|discovery') THEN 'template_port_scan' END, CASE WHEN regexp_matches(lower(message), 'outbound|c2|beacon') THEN 'outbound' END, CASE WHEN hour(ts) < 6 THEN 'off_hours' END, CASE WHEN user_id % 17 = 0 THEN 'known_malicious_ip' END, CASE WHEN abs(score - score2) > 0.3 THEN 'std_dev_high' END, CASE WHEN score2 > 0.7 THEN 'ae_high' END], lambda x: x IS NOT NULL) AS flags FROM alerts),
r(rule_id, priority, trig, threshold, tac) AS (VALUES """ + ", ".join(f"('{a}', {b}, '{c}', {d}, '{f}')" for a, b, c, d, _, f in MITRE_RULES) + """),
m AS (SELECT event_id, list(DISTINCT r.tac) AS tags, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY priority, rule_id) AS rn FROM f JOIN r ON score >= threshold AND (len(flags) = 0 OR list_contains(flags, trig))) r WHERE rn <= CASE WHEN len(flags) = 0 THEN 5 ELSE 25 END GROUP BY event_id),
o AS (SELECT event_id, tactic, coalesce(tags, []) AS tags, coalesce(n, 0) AS n FROM alerts LEFT JOIN m USING (event_id)), p AS (SELECT event_id, n + (NOT list_contains(tags, tactic))::INT AS matches, list_sort(CASE WHEN list_contains(tags, tactic) THEN tags ELSE list_append(tags, tactic) END) AS tags FROM o)
SELECT event_id, array_to_string(tags, ',') AS tactics, matches, len(list_filter(tags, lambda t: t <> ''))::INT AS tactic_breadth FROM p""")
def h8(spark, d):
    ev = alerts_of(log_events(spark, d)).withColumns({"off_hours": (F.hour("ts") < 6).cast("int"), "ioc_match": (F.col("user_id") % 17 == 0).cast("int"), "score_std": F.abs(F.col("score") - F.col("score2"))})
    ev = ev.withColumn("flags", H.trigger_flags(ev))
    rules = spark.createDataFrame([(a, b, [c], e, f, g) for a, b, c, e, f, g in MITRE_RULES], "rule_id string, priority int, triggers array<string>, threshold double, technique string, rule_tactic string").withColumnRenamed("rule_tactic", "tactic")
    return H.mitre_match(ev, rules).withColumn("tactics", F.array_join("tactics", ","))


@query("h10_hunter_vector", EV_SQL + "SELECT event_id, 46 AS n, round(score + 5 * k + 22 * severity + 41 * score3 + 43 * score2 + 46 * value, 6) AS total FROM ev")
def h10(spark, d):
    given = {"score": "adjusted_score", "k": "temporal_boost", "severity": "temporal_escalation_count", "score3": "spc_baseline_mean", "score2": "ae_score", "value": "entity_event_rate"}
    ev = log_events(spark, d).select("event_id", *[F.col(c).alias(name) for c, name in given.items()])
    placed = F.transform("v", lambda x, i: x * (i + 1))  # each feature counts by its place
    return ev.select("event_id", H.hunter_vector(ev).alias("v")).select("event_id", F.size("v").alias("n"), F.aggregate(placed, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("h11_heuristic_score", EV_SQL + "SELECT event_id, round(least(greatest(0.38 * least(greatest(score, 0), 1) + 0.06 * score2 + 0.04 * least(k / 5, 1) + 0.03 * least(severity / 10, 1) + 0.02 * least(k / 50, 1) + 0.03 + 0.02 + 0.01, 0), 1), 6)::DOUBLE AS h FROM ev")
def h11(spark, d):
    ev = log_events(spark, d).select("event_id", F.col("score").alias("adjusted_score"), F.col("score2").alias("ae_score"), F.col("k").alias("sigma_hit_count"), F.col("severity").alias("spc_z_score"), F.col("k").alias("graph_unique_destinations"))
    return ev.select("event_id", H.heuristic_score(ev).alias("h"))


FINDING_SQL = """CASE WHEN sev >= 3 THEN 'CONFIRMED_ATTACK' WHEN camp THEN 'ACTIVE_CAMPAIGN' WHEN hits > 0 AND anom THEN 'CONFIRMED_ATTACK' WHEN hits > 0 AND tri >= 0.89 THEN 'CONFIRMED_ATTACK' WHEN tri >= 0.89 AND (anom OR kt) THEN 'CONFIRMED_ATTACK' WHEN hits > 0 OR tri >= 0.89 THEN 'BEHAVIOURAL_ANOMALY'
 WHEN anom AND s >= 0.42 THEN 'CONFIRMED_ATTACK' WHEN anom THEN 'ANOMALOUS_PATTERN' WHEN s >= 0.5 THEN 'CONFIRMED_ATTACK' WHEN s >= 0.33 THEN 'BEHAVIOURAL_ANOMALY' ELSE 'NORMAL_BEHAVIOUR' END"""
SIGNALS_SQL = EV_SQL + f", sig AS (SELECT *, k % 3 AS hits, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 4 END AS sev, k % 11 = 0 AS camp, k % 7 = 0 AS anom, score3 AS tri, k % 2 = 0 AS kt, score2 AS s FROM ev), found AS (SELECT *, {FINDING_SQL} AS finding_type FROM sig)\n"


def found(spark, d):
    k = F.col("k")
    f = H.finding_type(k % 3, F.when(k % 3 == 0, 0).otherwise(k % 4), k % 11 == 0, k % 7 == 0, F.col("score3"), k % 2 == 0, F.col("score2"))
    return log_events(spark, d).withColumn("finding_type", f)


@query("h12_finding_type", SIGNALS_SQL + "SELECT event_id, finding_type FROM found")
def h12(spark, d):
    return found(spark, d).select("event_id", "finding_type")


@query("h13_attack_graph", EV_SQL + "SELECT event_id, 3 + ((k % 3 > 0)::INT + (k % 11 = 0)::INT + (k % 7 = 0)::INT + (k % 5 = 0)::INT) AS nodes, 2 + ((k % 3 > 0)::INT + (k % 11 = 0)::INT + (k % 7 = 0)::INT + (k % 5 = 0)::INT) AS edges, CASE WHEN (k % 3 > 0)::INT + (k % 11 = 0)::INT + (k % 7 = 0)::INT + (k % 5 = 0)::INT >= 3 THEN 'rich' WHEN (k % 3 > 0)::INT + (k % 11 = 0)::INT + (k % 7 = 0)::INT + (k % 5 = 0)::INT >= 1 THEN 'medium' ELSE 'sparse' END AS density FROM ev")
def h13(spark, d):
    k = F.col("k")
    ev = log_events(spark, d).withColumns({"hit_count": k % 3, "is_campaign": k % 11 == 0, "is_anomaly": k % 7 == 0, "ioc_match": (k % 5 == 0).cast("int")})
    return ev.select("event_id", H.attack_graph(ev).alias("g")).select("event_id", F.size("g.nodes").alias("nodes"), F.size("g.edges").alias("edges"), "g.density")


@query("h14_fast_path", EV_SQL + "SELECT event_id, 'CONFIRMED_ATTACK' AS finding_type, 0.95::DOUBLE AS confidence FROM ev WHERE k % 8 = 0")
def h14(spark, d):
    return H.fast_path_verdicts(log_events(spark, d).withColumn("fast_path", F.col("k") % 8 == 0))


@query("h15_tactic_arrays", EV_SQL + "SELECT event_id, 1 + (tactic <> 'discovery')::INT AS n, 50 AS m FROM ev")
def h15(spark, d):
    arrays = H.tactic_arrays(F.array("tactic", F.lit("discovery"), "tactic"), F.sequence(F.lit(1), F.lit(80)))
    return log_events(spark, d).select("event_id", arrays.alias("a")).select("event_id", F.size("a.tactics").alias("n"), F.size("a.correlated").alias("m"))


@query("h16_training_rows", SIGNALS_SQL + "SELECT event_id, CASE WHEN finding_type = 'NORMAL_BEHAVIOUR' THEN 0 ELSE 1 END AS label FROM found WHERE k % 8 <> 0 AND score >= 0.2 AND finding_type IN ('CONFIRMED_ATTACK', 'ACTIVE_CAMPAIGN', 'NORMAL_BEHAVIOUR')")
def h16(spark, d):
    return H.training_rows(found(spark, d).withColumn("fast_path", F.col("k") % 8 == 0)).select("event_id", "label")


@query("h17_training_set", SIGNALS_SQL + ", t AS (SELECT event_id, us, CASE WHEN finding_type = 'NORMAL_BEHAVIOUR' THEN 0 ELSE 1 END AS label FROM found WHERE k % 8 <> 0 AND score >= 0.2 AND finding_type IN ('CONFIRMED_ATTACK', 'ACTIVE_CAMPAIGN', 'NORMAL_BEHAVIOUR')), n AS (SELECT * FROM t ORDER BY us DESC, event_id DESC LIMIT 50000) SELECT event_id, label FROM n WHERE (SELECT count(*) >= 100 AND avg((label = 0)::INT) >= 0.10 FROM n)")
def h17(spark, d):
    rows = H.training_rows(found(spark, d).withColumn("fast_path", F.col("k") % 8 == 0))
    return H.training_set(rows).select("event_id", "label")


@query("h3_rule_pack", ALERTS_SQL + f", m AS (SELECT a.event_id, {MEASURES_SQL} FROM alerts a JOIN logs f ON f.host = a.host AND f.us BETWEEN a.us - {6 * HOUR} AND a.us GROUP BY a.event_id) SELECT event_id, unnest(list_filter({_rule_sql('name')}, lambda x: x IS NOT NULL)) AS rule FROM alerts LEFT JOIN m USING (event_id)")
def h3(spark, d):
    ev = log_events(spark, d)
    return H.rule_hits(alerts_of(ev), ev, minutes=360).select("event_id", F.explode("rules").alias("rule"))
