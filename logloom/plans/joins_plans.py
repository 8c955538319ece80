"""Queries of the joins and set operations (inventory D, K) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import joins as J
from logloom.operators import sets as K
from logloom.plans.aggregates import SCORED_SQL, scored
from logloom.plans.registry import query
from logloom.sources.fixtures import EV_SQL, log_events

#: Indicators: the addresses of users whose number is a multiple of 17; half of them expire.
IOC_SQL = ", ioc AS (SELECT DISTINCT src_ip AS value, 50 + user_id % 50 AS confidence, CASE WHEN user_id % 2 = 0 THEN epoch_us(TIMESTAMP '2024-01-15') END AS expires_at FROM ev WHERE user_id % 17 = 0)\n"
HOUR = 3_600_000_000


def indicators(ev):
    return ev.filter("user_id % 17 = 0").select(F.col("src_ip").alias("value"), (50 + F.col("user_id") % 50).alias("confidence"), F.when(F.col("user_id") % 2 == 0, F.lit(1705276800000000)).alias("expires_at")).distinct()


@query("d1_ioc_match", EV_SQL + IOC_SQL + ", live AS (SELECT value, max(confidence) AS c FROM ioc WHERE expires_at IS NULL OR expires_at > epoch_us(TIMESTAMP '2024-01-20') GROUP BY value) SELECT event_id, (coalesce(a.c, b.c) IS NOT NULL)::INT AS ioc_match, coalesce(a.c, b.c, 0) AS ioc_confidence FROM ev LEFT JOIN live a ON a.value = src_ip LEFT JOIN live b ON b.value = dst_ip")
def d1(spark, d):
    ev = log_events(spark, d)
    return J.ioc_match(ev, indicators(ev), F.lit(1705708800000000)).select("event_id", "ioc_match", "ioc_confidence")


@query("d2_allowlist", EV_SQL + "SELECT event_id, user_id % 19 = 0 OR host = 'host-3' AS allowed FROM ev")
def d2(spark, d):
    ev = log_events(spark, d)
    users = ev.filter("user_id % 19 = 0").select(F.lit("user").alias("kind"), F.col("usr").alias("value"), F.lit(True).alias("active")).distinct()
    hosts = ev.filter("host in ('host-3', 'host-4')").select(F.lit("host").alias("kind"), F.col("host").alias("value"), (F.col("host") == "host-3").alias("active")).distinct()
    return J.allowlist(ev, users.unionByName(hosts), {"user": "usr", "host": "host"}).select("event_id", "allowed")


@query("d3_ioc_flows", SCORED_SQL + f", bad AS (SELECT DISTINCT dst_ip FROM ev WHERE k % 20 = 3) SELECT a.event_id, count(*) AS flows FROM scored a JOIN ev f ON f.src_ip = a.src_ip AND f.us BETWEEN a.us - 72 * {HOUR} AND a.us JOIN bad ON bad.dst_ip = f.dst_ip WHERE a.action = 'escalate' GROUP BY a.event_id")
def d3(spark, d):
    ev = scored(spark, d)
    bad = ev.filter("k % 20 = 3").select(F.col("dst_ip").alias("value")).distinct()
    return J.ioc_flows(ev.filter("action = 'escalate'").select("event_id", "src_ip", "us"), ev, bad).groupBy("event_id").agg(F.count("*").alias("flows"))


@query("d4_alert_scores", EV_SQL + ", s AS (SELECT event_id, score2 AS score, us AS at_us FROM ev WHERE k % 3 = 0 UNION ALL SELECT event_id, score3, us + 1 FROM ev WHERE k % 6 = 0) SELECT event_id, round(max_by(s.score, at_us), 6) AS latest_score FROM ev LEFT JOIN s USING (event_id) WHERE severity >= 2 GROUP BY event_id")
def d4(spark, d):
    ev = log_events(spark, d)
    first = ev.filter("k % 3 = 0").select("event_id", F.col("score2").alias("score"), F.col("us").alias("scored_us"))
    second = ev.filter("k % 6 = 0").select("event_id", F.col("score3").alias("score"), (F.col("us") + 1).alias("scored_us"))
    return J.alert_scores(ev, first.unionByName(second)).select("event_id", "latest_score")


@query("d5_investigation_list", EV_SQL + ", v AS (SELECT event_id % 1000 AS i, event_id, us FROM ev WHERE severity = 4) SELECT event_id AS investigation_id, x.e AS verification_id FROM ev LEFT JOIN (SELECT i, max_by(event_id, us) AS e FROM v GROUP BY i) x ON x.i = ev.event_id WHERE severity = 3")
def d5(spark, d):
    ev = log_events(spark, d)
    inv = ev.filter("severity = 3").select(F.col("event_id").alias("investigation_id"))
    ver = ev.filter("severity = 4").select((F.col("event_id") % 1000).alias("investigation_id"), F.col("event_id").alias("verification_id"), F.col("us").alias("verified_us"))
    return J.investigation_list(inv, ver).select("investigation_id", "verification_id")


@query("d6_asset_multiplier", EV_SQL + "SELECT event_id, CASE WHEN host ILIKE 'HOST-1_' THEN 2.0 WHEN host ILIKE 'host-1%' THEN 1.5 WHEN host ILIKE '%5' THEN 1.2 ELSE 1.0 END::DOUBLE AS multiplier FROM ev")
def d6(spark, d):
    assets = spark.createDataFrame([("HOST-1_", 2.0, 1), ("host-1%", 1.5, 2), ("%5", 1.2, 3)], "pattern string, multiplier double, priority int")
    return J.asset_multiplier(log_events(spark, d), assets).select("event_id", "multiplier")


@query("d7_threshold_lookup", EV_SQL + "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.3 WHEN source = 'nginx' THEN 0.45 ELSE 0.39 END::DOUBLE AS suspicious, CASE WHEN event_type = 'error' THEN 0.8 WHEN source = 'nginx' THEN 0.9 ELSE 0.95 END::DOUBLE AS anomalous FROM ev")
def d7(spark, d):
    thresholds = spark.createDataFrame([("error", 0.3, 0.8), ("nginx", 0.45, 0.9)], "key string, suspicious double, anomalous double")
    return J.threshold_lookup(log_events(spark, d), thresholds, "event_type", "source").select("event_id", "suspicious", "anomalous")


@query("d8_feedback_join", EV_SQL + "SELECT event_id, host, label FROM (SELECT event_id, host, CASE WHEN k % 2 = 0 THEN 'tp' ELSE 'fp' END AS label, row_number() OVER (PARTITION BY host ORDER BY us DESC, event_id DESC) AS r FROM ev WHERE k % 5 = 0) WHERE r <= 20")
def d8(spark, d):
    ev = log_events(spark, d)
    labels = ev.filter("k % 5 = 0").select("event_id", F.when(F.col("k") % 2 == 0, "tp").otherwise("fp").alias("label"))
    return J.feedback_join(ev.select("event_id", "host", "us"), labels, "host").select("event_id", "host", "label")


@query("d9_prior_verdicts", EV_SQL + "SELECT entity, event_id AS alert_id FROM (SELECT host AS entity, event_id, row_number() OVER (PARTITION BY host ORDER BY us DESC, event_id DESC) AS r FROM ev WHERE severity = 4) WHERE r <= 10")
def d9(spark, d):
    ev = log_events(spark, d)
    verdicts = ev.filter("severity = 4").select(F.col("event_id").alias("alert_id"), "us")
    return J.prior_verdicts(verdicts, ev.filter("severity >= 3").select(F.col("event_id").alias("alert_id"), F.col("host").alias("entity"))).select("entity", "alert_id")


@query("d10_rare_or_ioc_sources", EV_SQL + IOC_SQL + "SELECT event_id FROM ev WHERE src_ip IN (SELECT value FROM ioc) OR src_ip NOT IN (SELECT src_ip FROM ev GROUP BY src_ip HAVING count(*) > 70)")
def d10(spark, d):
    ev = log_events(spark, d)
    return J.rare_or_ioc_sources(ev, indicators(ev), ev, often=70).select("event_id")


@query("d11_score_of_investigation", EV_SQL + """, inv AS (SELECT event_id AS investigation_id, event_id + 7 AS event_id, host, score2 AS wanted FROM ev WHERE k % 25 = 0), sc AS (SELECT * FROM ev WHERE k % 2 = 1),
near AS (SELECT i.investigation_id, min_by(s.score2, abs(s.score2 - i.wanted) * 1e9 + s.event_id / 1e9) AS n FROM inv i JOIN sc s ON s.host = i.host AND abs(s.score2 - i.wanted) < 0.0151 GROUP BY 1)
SELECT i.investigation_id, round(coalesce(s.score2, n.n), 6) AS found_score FROM inv i LEFT JOIN sc s ON s.event_id = i.event_id LEFT JOIN near n ON n.investigation_id = i.investigation_id""")
def d11(spark, d):
    ev = log_events(spark, d)
    inv = ev.filter("k % 25 = 0").select(F.col("event_id").alias("investigation_id"), (F.col("event_id") + 7).alias("event_id"), "host", F.col("score2").alias("wanted_score"))
    return J.score_of_investigation(inv, ev.filter("k % 2 = 1").select("event_id", "host", F.col("score2").alias("score")), band=0.0151).select("investigation_id", "found_score")


@query("d12_investigation_detail", EV_SQL + "SELECT i.event_id, s.severity AS sec, l.message, c.usr AS verifier FROM ev i LEFT JOIN (SELECT * FROM ev WHERE severity >= 3) s USING (event_id) LEFT JOIN logs l USING (event_id) LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') c USING (event_id) WHERE i.score >= 0.2 OR i.severity >= 2")
def d12(spark, d):
    ev = log_events(spark, d)
    inv = ev.filter("score >= 0.2 or severity >= 2").select("event_id")
    parts = [ev.filter("severity >= 3").select("event_id", F.col("severity").alias("sec")), ev.select("event_id", "message"), ev.filter("event_type = 'error'").select("event_id", F.col("usr").alias("verifier"))]
    for part in parts:
        inv = inv.join(part, "event_id", "left")
    return inv


@query("d13_anchor_cover", EV_SQL + f", anchors AS (SELECT us // (6 * {HOUR}) AS anchor_id, min(us) AS time_from, max(us) AS time_to FROM ev GROUP BY 1) SELECT a.event_id, count(*) AS anchors, min(anchor_id) AS first_anchor FROM ev a JOIN anchors ON time_from <= a.us + 2 * {HOUR} AND time_to >= a.us - 2 * {HOUR} WHERE a.severity = 4 GROUP BY a.event_id")
def d13(spark, d):
    ev = log_events(spark, d)
    anchors = ev.groupBy(F.floor(F.col("us") / (6 * HOUR)).alias("anchor_id")).agg(F.min("us").alias("time_from"), F.max("us").alias("time_to"))
    return J.anchor_cover(ev.filter("severity = 4").select("event_id", "us"), anchors).groupBy("event_id").agg(F.count("*").alias("anchors"), F.min("anchor_id").alias("first_anchor"))


@query("d14_cross_table_ips", EV_SQL + "SELECT a.src_ip, severe, flows FROM (SELECT src_ip, count(*) AS severe FROM ev WHERE severity >= 4 GROUP BY 1) a JOIN (SELECT src_ip, count(*) AS flows FROM ev WHERE k % 2 = 1 GROUP BY 1) b USING (src_ip)")
def d14(spark, d):
    ev = log_events(spark, d)
    return J.cross_table_ips(ev.filter("severity >= 4"), ev.filter("k % 2 = 1"))


@query("d15_context_window_events", EV_SQL + f""", att AS (SELECT us, usr, host FROM ev WHERE severity = 4 AND k % 30 = 7), w AS (SELECT us - {HOUR} AS a, us + {HOUR} AS b FROM att), x AS (SELECT event_id FROM ev WHERE (us, usr) IN (SELECT us, usr FROM att))
SELECT event_id, 'attack' AS role FROM x UNION ALL SELECT event_id, 'context' FROM ev WHERE EXISTS (SELECT 1 FROM w WHERE ev.us BETWEEN a AND b) AND (usr IN (SELECT usr FROM att) OR host IN (SELECT host FROM att)) AND event_id NOT IN (SELECT event_id FROM x)""")
def d15(spark, d):
    from logloom.operators.windows import merge_windows

    ev = log_events(spark, d)
    attacks = ev.filter("severity = 4 and k % 30 = 7")
    windows = merge_windows(attacks.select(F.floor(F.col("us") / HOUR).alias("key"), (F.col("us") - HOUR).alias("start_us"), (F.col("us") + HOUR).alias("end_us")), "key", "start_us", "end_us")
    return J.context_window_events(ev, attacks, windows)


@query("d16_entity_history", SCORED_SQL + f"SELECT a.event_id, count(*) AS n, round(max(f.score), 6) AS top FROM scored a JOIN ev f ON f.host = a.host AND f.us BETWEEN a.us - 24 * {HOUR} AND a.us WHERE a.action = 'escalate' GROUP BY a.event_id")
def d16(spark, d):
    from logloom.operators.investigate import entity_history

    ev = scored(spark, d)
    return entity_history(ev.filter("action = 'escalate'"), ev, "host", 24 * HOUR, ["score"]).groupBy("event_id").agg(F.count("*").alias("n"), F.max("fact_score").alias("top"))


@query("d17_message_lookup", EV_SQL + "SELECT l.event_id, l.message AS text, round(s.score2, 6) AS score FROM logs l LEFT JOIN (SELECT * FROM ev WHERE severity >= 2) s USING (event_id)")
def d17(spark, d):
    ev = log_events(spark, d)
    families = [ev.filter(f"coalesce(severity, 0) {of} 3").select("event_id", F.col("message").alias("text")) for of in ("<", ">=")]
    return J.message_lookup(families, ev.filter("severity >= 2").select("event_id", F.col("score2").alias("score")))


@query("d18_reconcile", EV_SQL + "SELECT k, count(*) AS sent, count(*) FILTER (WHERE event_id % 7 <> 0) AS found, round(count(*) FILTER (WHERE event_id % 7 = 0) / count(*) * 100, 6) AS loss_pct FROM ev GROUP BY k")
def d18(spark, d):
    ev = log_events(spark, d)
    return J.reconcile(ev, ev.filter("event_id % 7 <> 0"), "k")


@query("d19_new_only", EV_SQL + "SELECT event_id FROM ev WHERE k % 4 <> 0")
def d19(spark, d):
    ev = log_events(spark, d)
    return J.new_only(ev, ev.filter("k % 4 = 0")).select("event_id")


FEED = ["event_id", "us", "host", "severity"]


@query("k1_union_feed", EV_SQL + " , f AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY us DESC, event_id DESC) AS r FROM (SELECT CASE k % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'security' WHEN 2 THEN 'process' ELSE 'network' END AS feed, event_id, us, host, severity FROM ev)) SELECT feed, event_id, us, host, severity FROM f WHERE r <= 25 ORDER BY us DESC, event_id DESC LIMIT 100")
def k1(spark, d):
    ev = log_events(spark, d)
    return K.union_feed({name: ev.filter(f"k % 4 = {i}") for i, name in enumerate(("raw", "security", "process", "network"))}, FEED, "us", "event_id")


@query("k3_distinct_values", EV_SQL + "SELECT DISTINCT host, tactic FROM ev")
def k3(spark, d):
    return K.distinct_values(log_events(spark, d), ["host", "tactic"])


@query("k4_top_k_offset", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def k4(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("k5_ranked_order", EV_SQL + "SELECT event_id, p AS priority FROM (SELECT event_id, us, CASE k % 5 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P3' WHEN 3 THEN 'P4' ELSE 'none' END AS p FROM ev) ORDER BY CASE p WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 WHEN 'P4' THEN 4 ELSE 9 END, us, event_id")
def k5(spark, d):
    p = F.element_at(F.array(*map(F.lit, ("P1", "P2", "P3", "P4", "none"))), F.col("k") % 5 + 1)
    return K.ranked_order(log_events(spark, d).withColumn("priority", p), "priority", [F.col("us"), F.col("event_id")]).select("event_id", "priority")


@query("k6_exists_in_not_in", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def k6(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    done, urgent = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(done, "c_custkey", "left_semi").join(urgent, "c_custkey", "left_anti")


@query("k7_repeatable_sample", SCORED_SQL + "SELECT event_id, action FROM scored ORDER BY md5(event_id || ':42'), event_id LIMIT 300")
def k7(spark, d):
    return K.repeatable_sample(scored(spark, d), "event_id", 300).select("event_id", "action")
