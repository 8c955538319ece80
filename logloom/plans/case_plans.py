"""Queries of case graphs and reports (inventory C15, C16, H13, I15) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import cases as C
from logloom.plans.registry import query
from logloom.sources.fixtures import EV_SQL, log_events

FOUND = ("CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN", "BEHAVIOURAL_ANOMALY", "SIGMA_MATCH", "ANOMALOUS_PATTERN", "NORMAL_BEHAVIOUR", "FALSE_POSITIVE", "NEW_KIND")
VERDICTS = ("true_positive", "inconclusive", "false_positive")


def cases_of(spark, d):
    """A case for every event, with signals that hang on its k."""
    k = F.col("k")
    ev = log_events(spark, d)
    some = lambda n, f: F.transform(F.when(n > 0, F.sequence(F.lit(1).cast("int"), n.cast("int"))).otherwise(F.array().cast("array<int>")), f)
    return ev.select(
        "event_id", "host", "src_ip", F.when(k % 9 == 0, "unknown").otherwise(F.col("usr")).alias("usr"), "source", F.when(k % 4 != 1, F.col("message")).alias("message"), (k / 100).alias("score"), (k / 250).alias("case_score"),
        F.element_at(F.array(*map(F.lit, FOUND)), k % 8 + 1).alias("finding_type"),
        some(k % 7, lambda i: F.struct(F.concat(F.lit("rule-"), i).alias("name"), ((i - 1) % 4 + 1).alias("severity"))).alias("rules"),
        (k / 10).alias("z"), (k % 6 == 0).alias("is_anomaly"), (k % 4).cast("long").alias("destinations"), (k % 3).cast("long").alias("hops"), (k % 5 == 0).cast("int").alias("ioc_neighbor"), (k / 100).alias("lateral"), (k / 250).alias("c2"),
        F.when(k % 2 == 0, k % 10).otherwise(0).cast("long").alias("escalations"), some(k % 10, lambda i: F.concat(F.lit("a"), F.col("user_id"), F.lit("-"), i)).alias("related"), (k % 3).cast("long").alias("similar"), (k / 100).alias("nearest"),
        F.when(k % 8 == 7, F.array().cast("array<string>")).when(k % 3 == 0, F.array("tactic", F.lit("initial-access"), "tactic", F.lit("other"))).otherwise(F.array("tactic")).alias("tactics"),
        F.when(k % 11 == 0, F.concat(F.lit("c-"), F.col("user_id") % 5)).alias("campaign_id"), F.array(F.lit("host-0"), "host", F.lit("host-1")).alias("campaign_hosts"),
        (k % 3 != 0).alias("verified"), (k % 10 != 3).alias("intact"), some(k % 8, lambda i: F.concat(F.lit("b-"), i)).alias("batches"), some(F.when(k % 5 == 0, k % 7).otherwise(0), lambda i: F.struct(F.concat(F.lit("10.9.9."), i).alias("value"), F.lit("ip").alias("kind"))).alias("matches"),
        (k * 2).cast("long").alias("flows"), (k + 1).cast("long").alias("timeline_events"), (k % 13 != 0).alias("coherent"), (k % 5).cast("long").alias("false_positives"), (k % 4).cast("long").alias("true_positives"),
        F.element_at(F.array(*map(F.lit, VERDICTS)), k % 3 + 1).alias("verdict"), F.when(k % 2 == 0, "P1").otherwise("P2").alias("priority"), (k / 100).alias("confidence"),
    )


def _case(values: tuple, index: str) -> str:
    return "[" + ", ".join(repr(v) for v in values) + f"][{index} + 1]"


TACTIC_SQL = "[" + ", ".join(repr(t) for t in C.TACTICS) + "]"
#: CTE c: the cases. rules, related, batches, matches have their number first.
CASES_SQL = EV_SQL + f""", c AS (SELECT event_id, host, src_ip, CASE WHEN k % 9 = 0 THEN 'unknown' ELSE usr END AS usr, source, CASE WHEN k % 4 <> 1 THEN message ELSE '' END AS message, k / 100 AS score, k / 250 AS case_score, {_case(FOUND, 'k % 8')} AS finding,
  (k % 7)::INT AS n_rules, k / 10 AS z, k % 6 = 0 AS anomaly, k % 4 AS destinations, k % 3 AS hops, k % 5 = 0 AS ioc, CASE WHEN k % 2 = 0 THEN k % 10 ELSE 0 END AS escalations, (k % 10)::INT AS n_related, user_id, k % 3 AS alike, k,
  CASE WHEN k % 8 = 7 THEN [] WHEN k % 3 = 0 THEN list_append(list_sort(list_distinct([(list_position({TACTIC_SQL}, tactic)), 3])), 99) ELSE [list_position({TACTIC_SQL}, tactic)] END AS places,
  CASE WHEN k % 11 = 0 THEN 'c-' || (user_id % 5) END AS campaign, k % 3 <> 0 AS verified, k % 10 <> 3 AS intact, (k % 8)::INT AS n_batches, (CASE WHEN k % 5 = 0 THEN k % 7 ELSE 0 END)::INT AS n_matches, k % 13 <> 0 AS coherent, k % 5 AS fp, k % 4 AS tp, {_case(VERDICTS, 'k % 3')} AS verdict, CASE WHEN k % 2 = 0 THEN 'P1' ELSE 'P2' END AS priority FROM logs),
t AS (SELECT *, list_transform(places, lambda p: CASE WHEN p = 99 THEN 'other' ELSE {TACTIC_SQL}[p] END) AS tactics FROM c),
r AS (SELECT event_id, host, tactics, unnest(range(1, least(n_rules, 5) + 1)) AS i FROM t), a AS (SELECT event_id, user_id, unnest(range(1, least(n_related, 6) + 1)) AS i FROM t WHERE escalations > 0),
tt AS (SELECT event_id, host, unnest(tactics) AS tactic, generate_subscripts(tactics, 1) AS i FROM t), h AS (SELECT event_id, host, campaign, unnest(list_distinct(['host-0', host, 'host-1'])) AS other FROM t WHERE campaign IS NOT NULL)
"""
NODES_SQL = """nodes AS (
  SELECT event_id, 'host:' || host AS id, 'host' AS kind, host AS label, NULL AS status FROM t UNION ALL SELECT event_id, 'ip:' || src_ip, 'ip', src_ip, NULL FROM t UNION ALL SELECT event_id, 'user:' || usr, 'user', usr, NULL FROM t WHERE usr <> 'unknown'
  UNION ALL SELECT event_id, 'rule:rule-' || i, 'rule', 'rule-' || i || ' ' || ['low', 'medium', 'high', 'critical'][(i - 1) % 4 + 1], NULL FROM r UNION ALL SELECT event_id, 'volume:' || event_id, 'volume', printf('z %.2f', z), NULL FROM t WHERE anomaly
  UNION ALL SELECT event_id, 'network:' || event_id, 'network', destinations || ' destinations, ' || hops || ' hops', NULL FROM t WHERE destinations > 0 UNION ALL SELECT event_id, 'indicator:' || event_id, 'indicator', 'known indicator', NULL FROM t WHERE ioc
  UNION ALL SELECT event_id, 'lateral:' || event_id, 'lateral', printf('%.2f', k / 100), NULL FROM t WHERE k / 100 > 0.1 UNION ALL SELECT event_id, 'c2:' || event_id, 'c2', printf('%.2f', k / 250), NULL FROM t WHERE k / 250 > 0.1
  UNION ALL SELECT event_id, 'history:' || event_id, 'history', escalations || ' escalations', NULL FROM t WHERE escalations > 0 UNION ALL SELECT event_id, 'alert:a' || user_id || '-' || i, 'alert', 'a' || user_id || '-' || i, NULL FROM a
  UNION ALL SELECT event_id, 'similarity:' || event_id, 'similarity', alike || ' similar, nearest ' || printf('%.2f', k / 100), NULL FROM t WHERE alike > 0 UNION ALL SELECT event_id, 'tactic:' || tactic, 'tactic', tactic, NULL FROM tt
  UNION ALL SELECT event_id, 'campaign:' || campaign, 'campaign', campaign, NULL FROM t WHERE campaign IS NOT NULL UNION ALL SELECT event_id, 'host:' || other, 'host', other, NULL FROM h WHERE other <> host UNION ALL SELECT event_id, 'finding:' || event_id, 'finding', finding, NULL FROM t)
"""
EDGES_SQL = """edges AS (
  SELECT event_id, 'ip:' || src_ip AS source, 'host:' || host AS target, 'connects' AS kind FROM t UNION ALL SELECT event_id, 'user:' || usr, 'host:' || host, 'acts' FROM t WHERE usr <> 'unknown' UNION ALL SELECT event_id, 'host:' || host, 'rule:rule-' || i, 'detects' FROM r
  UNION ALL SELECT event_id, 'host:' || host, 'volume:' || event_id, 'deviates' FROM t WHERE anomaly UNION ALL SELECT event_id, 'host:' || host, 'network:' || event_id, 'reaches' FROM t WHERE destinations > 0
  UNION ALL SELECT event_id, CASE WHEN destinations > 0 THEN 'network:' || event_id ELSE 'host:' || host END, 'indicator:' || event_id, 'meets' FROM t WHERE ioc UNION ALL SELECT event_id, 'host:' || host, 'lateral:' || event_id, 'lateral' FROM t WHERE k / 100 > 0.1
  UNION ALL SELECT event_id, 'host:' || host, 'c2:' || event_id, 'c2' FROM t WHERE k / 250 > 0.1 UNION ALL SELECT event_id, 'history:' || event_id, 'host:' || host, 'precedes' FROM t WHERE escalations > 0
  UNION ALL SELECT event_id, 'alert:a' || user_id || '-' || i, 'history:' || event_id, 'relates' FROM a UNION ALL SELECT event_id, 'similarity:' || event_id, 'host:' || host, 'resembles' FROM t WHERE alike > 0
  UNION ALL SELECT event_id, 'host:' || host, 'tactic:' || tactic, 'begins' FROM tt WHERE i = 1 UNION ALL SELECT x.event_id, 'tactic:' || x.tactic, 'tactic:' || y.tactic, 'progresses' FROM tt x JOIN tt y ON x.event_id = y.event_id AND y.i = x.i + 1
  UNION ALL SELECT event_id, 'rule:rule-' || i, 'tactic:' || tactics[1], 'triggers' FROM r WHERE i <= 3 AND len(tactics) > 0 UNION ALL SELECT event_id, 'host:' || host, 'campaign:' || campaign, 'takes part' FROM t WHERE campaign IS NOT NULL
  UNION ALL SELECT event_id, 'campaign:' || campaign, 'host:' || other, 'coordinates' FROM h UNION ALL SELECT event_id, 'host:' || host, 'finding:' || event_id, 'found' FROM t)
"""
CHECKS = "['evidence', 'indicators', 'timeline', 'false positives']"


@query("h13_graph_nodes", CASES_SQL + "," + NODES_SQL + "SELECT id, kind, min(label) AS label, count(*) AS cases FROM nodes GROUP BY id, kind")
def h13_graph_nodes(spark, d):
    """The nodes of all cases together."""
    nodes = C.graph_nodes(C.case_graphs(cases_of(spark, d)))
    return nodes.groupBy("id", "kind").agg(F.min("label").alias("label"), F.count("*").alias("cases"))


@query("h13_graph_edges", CASES_SQL + "," + EDGES_SQL + "SELECT source, target, kind, count(*) AS cases FROM edges GROUP BY ALL")
def h13_graph_edges(spark, d):
    return C.merged_graph(C.case_graphs(cases_of(spark, d)))[1]


@query("h13_graph_density", CASES_SQL + ", n AS (SELECT event_id, (n_rules > 0)::INT + anomaly::INT + (destinations > 0 OR ioc OR hops > 0)::INT + (escalations > 0)::INT + (alike > 0)::INT + (len(tactics) > 0)::INT + (campaign IS NOT NULL)::INT AS signals FROM t) SELECT event_id, signals, CASE WHEN signals >= 4 THEN 'rich' WHEN signals >= 2 THEN 'medium' ELSE 'sparse' END AS density FROM n")
def h13_graph_density(spark, d):
    return C.case_graphs(cases_of(spark, d)).select("event_id", "signals", "density")


@query("i15_check_nodes", CASES_SQL + f""", k AS (SELECT *, unnest({CHECKS}) AS name FROM t) SELECT event_id, 'check:' || name || ':' || event_id AS id, 'check' AS kind,
  CASE name WHEN 'evidence' THEN n_batches || ' batches' WHEN 'indicators' THEN n_matches || ' matches, ' || (k * 2) || ' flows' WHEN 'timeline' THEN (k + 1) || ' events' ELSE fp || ' of ' || (fp + tp) END AS label,
  CASE name WHEN 'evidence' THEN CASE WHEN verified AND intact THEN 'pass' ELSE 'fail' END WHEN 'indicators' THEN CASE WHEN n_matches > 0 THEN 'pass' ELSE 'neutral' END WHEN 'timeline' THEN CASE WHEN coherent THEN 'pass' ELSE 'warn' END ELSE CASE WHEN fp > tp THEN 'fail' ELSE 'pass' END END AS status FROM k
UNION ALL SELECT event_id, 'batch:b-' || i, 'batch', 'b-' || i, NULL FROM (SELECT event_id, unnest(range(1, least(n_batches, 5) + 1)) AS i FROM t)
UNION ALL SELECT event_id, 'indicator:10.9.9.' || i, 'indicator', '10.9.9.' || i || ' ip', NULL FROM (SELECT event_id, unnest(range(1, least(n_matches, 5) + 1)) AS i FROM t)
UNION ALL SELECT event_id, 'verdict:' || event_id, 'verdict', verdict || ' ' || priority, NULL FROM t""")
def i15_check_nodes(spark, d):
    """What verification adds to the graphs: checks with their status, batches, matches, the verdict."""
    return C.graph_nodes(C.verification_graphs(cases_of(spark, d)))


@query("i15_check_edges", CASES_SQL + f""", k AS (SELECT *, unnest({CHECKS}) AS name FROM t) SELECT event_id, 'finding:' || event_id AS source, 'check:' || name || ':' || event_id AS target, 'verifies' AS kind FROM k UNION ALL SELECT event_id, 'check:' || name || ':' || event_id, 'verdict:' || event_id, 'contributes' FROM k
UNION ALL SELECT event_id, 'check:evidence:' || event_id, 'batch:b-' || i, 'holds' FROM (SELECT event_id, unnest(range(1, least(n_batches, 5) + 1)) AS i FROM t) UNION ALL SELECT event_id, 'check:indicators:' || event_id, 'indicator:10.9.9.' || i, 'matches' FROM (SELECT event_id, unnest(range(1, least(n_matches, 5) + 1)) AS i FROM t)""")
def i15_check_edges(spark, d):
    return C.graph_edges(C.verification_graphs(cases_of(spark, d)))


_FINDING_SQL = lambda i: "CASE finding " + " ".join(f"WHEN {n!r} THEN '{v[i]}'" for n, v in C.FINDINGS.items()) + f" ELSE '{C.OTHER_FINDING[i]}' END"
SECTIONS_SQL = f"""lines AS (
  SELECT event_id, 'subject' AS section, host || ' | ' || src_ip || ' | ' || usr || ' | triage ' || printf('%.2f', score) || ' | score ' || printf('%.2f', case_score) AS line FROM t
  UNION ALL SELECT event_id, 'trigger', source || CASE WHEN message = '' THEN '' ELSE ': ' || message END FROM t
  UNION ALL SELECT event_id, CASE WHEN n_rules > 0 THEN 'fired' ELSE 'not fired' END, CASE WHEN n_rules > 0 THEN 'rules: ' || n_rules || ' rules: ' || array_to_string(list_transform(range(1, least(n_rules, 5) + 1), lambda i: 'rule-' || i), ', ') ELSE 'rules' END FROM t
  UNION ALL SELECT event_id, CASE WHEN anomaly THEN 'fired' ELSE 'not fired' END, CASE WHEN anomaly THEN printf('volume: z %.2f', z) ELSE 'volume' END FROM t
  UNION ALL SELECT event_id, CASE WHEN destinations > 0 OR ioc OR hops > 0 THEN 'fired' ELSE 'not fired' END, CASE WHEN destinations > 0 OR ioc OR hops > 0 THEN 'network: ' || destinations || ' destinations, ' || hops || ' hops' || CASE WHEN ioc THEN ', known indicator' ELSE '' END ELSE 'network' END FROM t
  UNION ALL SELECT event_id, CASE WHEN escalations > 0 THEN 'fired' ELSE 'not fired' END, CASE WHEN escalations > 0 THEN 'history: ' || escalations || ' escalations, related ' || array_to_string(list_transform(range(1, least(n_related, 6) + 1), lambda i: 'a' || user_id || '-' || i), ', ') || CASE WHEN n_related > 6 THEN ' and ' || (n_related - 6) || ' more' ELSE '' END ELSE 'history' END FROM t
  UNION ALL SELECT event_id, CASE WHEN alike > 0 THEN 'fired' ELSE 'not fired' END, CASE WHEN alike > 0 THEN 'similarity: ' || alike || ' similar attacks, nearest ' || printf('%.2f', k / 100) ELSE 'similarity' END FROM t
  UNION ALL SELECT event_id, CASE WHEN len(tactics) > 0 THEN 'fired' ELSE 'not fired' END, CASE WHEN len(tactics) > 0 THEN 'tactics: ' || len(tactics) || ' tactics' ELSE 'tactics' END FROM t
  UNION ALL SELECT event_id, CASE WHEN campaign IS NOT NULL THEN 'fired' ELSE 'not fired' END, CASE WHEN campaign IS NOT NULL THEN 'campaign: 3 hosts' ELSE 'campaign' END FROM t
  UNION ALL SELECT event_id, 'kill chain', array_to_string(tactics, ' > ') FROM t WHERE len(tactics) > 0
  UNION ALL SELECT event_id, 'kill chain', len(tactics) || CASE WHEN len(tactics) >= 3 THEN ' phases: advanced persistent threat' ELSE ' phases: multi-stage attack' END FROM t WHERE len(tactics) > 1
  UNION ALL SELECT event_id, 'campaign', campaign || ': host-0, ' || host || ', host-1' FROM t WHERE campaign IS NOT NULL
  UNION ALL SELECT event_id, 'finding', finding || ' | ' || {_FINDING_SQL(0)} || ' | ' || {_FINDING_SQL(1)} FROM t)
"""


@query("c16_report_lines", CASES_SQL + "," + SECTIONS_SQL + "SELECT * FROM lines")
def c16_report_lines(spark, d):
    """The lines of every case's report; a section only where its signal fired."""
    return C.report_lines(cases_of(spark, d)).drop("place")


@query("c16_verification_lines", CASES_SQL + """SELECT event_id, 'evidence' AS section, CASE WHEN verified THEN 'verified' ELSE 'unverified' END || ', chain ' || CASE WHEN intact THEN 'intact' ELSE 'broken' END || ', ' || n_batches || ' batches' AS line FROM t
UNION ALL SELECT event_id, 'evidence', 'warning: logs may have been changed between collection and analysis' FROM t WHERE NOT intact UNION ALL SELECT event_id, 'indicators', CASE WHEN n_matches > 0 THEN 'corroborated' ELSE 'no match' END || ', ' || (k * 2) || ' flows' FROM t
UNION ALL SELECT event_id, 'indicators', array_to_string(list_transform(range(1, least(n_matches, 5) + 1), lambda i: '10.9.9.' || i || ' ip'), ', ') || CASE WHEN n_matches > 5 THEN ' and ' || (n_matches - 5) || ' more' ELSE '' END FROM t WHERE n_matches > 0
UNION ALL SELECT event_id, 'timeline', (k + 1) || ' events, ' || CASE WHEN coherent THEN 'coherent' ELSE 'out of order' END FROM t UNION ALL SELECT event_id, 'timeline', 'warning: the sequence may not be that of the attack' FROM t WHERE NOT coherent
UNION ALL SELECT event_id, 'false positives', fp || ' of ' || (fp + tp) || ' labels' FROM t UNION ALL SELECT event_id, 'false positives', CASE WHEN 2 * fp > fp + tp THEN 'high: similar alerts are mostly false' ELSE 'moderate' END FROM t WHERE fp > 0
UNION ALL SELECT event_id, 'verdict', verdict || ' | ' || priority || ' | ' || printf('%.2f', k / 100) || ' | ' || CASE WHEN verdict = 'true_positive' AND priority = 'P1' THEN 'IMMEDIATE: Isolate ' || host || ' (' || src_ip || '), revoke active sessions, engage IR team. Tactics: ' || CASE WHEN len(tactics) > 0 THEN array_to_string(tactics, ', ') ELSE 'N/A' END || '.'
 WHEN verdict = 'true_positive' THEN 'INVESTIGATE: Review ' || host || ' (' || src_ip || ') activity, check lateral movement, collect forensic artifacts. Finding: ' || finding || '.' WHEN verdict = 'inconclusive' THEN 'MONITOR: Increase monitoring for ' || host || ' (' || src_ip || '). Collect additional context before escalation. Finding: ' || finding || '.'
 ELSE 'NO ACTION: Verified as false positive for ' || host || '. Consider adding allowlist entry if recurring.' END FROM t""")
def c16_verification_lines(spark, d):
    return C.verification_lines(cases_of(spark, d)).drop("place")


@query("c15_finding_actions", EV_SQL + f", f AS (SELECT event_id, {_case(FOUND, 'k % 8')} AS finding FROM ev) SELECT event_id, {_FINDING_SQL(0)} AS severity, {_FINDING_SQL(1)} AS action FROM f")
def c15_finding_actions(spark, d):
    finding = F.element_at(F.array(*map(F.lit, FOUND)), F.col("k") % 8 + 1)
    return log_events(spark, d).select("event_id", C.finding_severity(finding).alias("severity"), C.finding_action(finding).alias("action"))
