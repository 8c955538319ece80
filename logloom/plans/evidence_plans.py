"""Queries of evidence and verification (inventory I) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import evidence as E
from logloom.plans.joins_plans import HOUR
from logloom.plans.registry import query
from logloom.sources.fixtures import EV_SQL, log_events

PARTS = ["event_id", "us", "host", "severity"]
DAY = 86400
LEAF_SQL = ", leaves AS (SELECT event_id, us, upper(sha256(event_id || us || host || severity)) AS leaf FROM ev), batched AS (SELECT *, CAST(floor((us / 1000000 - (SELECT floor(min(us) / 1000000) FROM ev)) / 86400) AS BIGINT) AS batch FROM leaves)\n"
ROOT_SQL = LEAF_SQL + """, numbered AS (SELECT batch, leaf, row_number() OVER (PARTITION BY batch ORDER BY event_id) - 1 AS pos FROM batched),
sizes AS (SELECT batch, count(*) AS leaf_count, CAST(greatest(1, ceil(log2(count(*)))) AS INTEGER) AS depth FROM batched GROUP BY batch),
padded AS (SELECT s.batch, depth, list(n.leaf ORDER BY pos) AS l, any_value(leaf_count) AS leaf_count FROM sizes s JOIN numbered n USING (batch) GROUP BY s.batch, depth),
start AS (SELECT batch, depth, leaf_count, list_concat(l, list_transform(range(leaf_count, CAST(pow(2, depth) AS BIGINT)), lambda i: l[-1])) AS l FROM padded),
tree AS (WITH RECURSIVE t(batch, depth, leaf_count, l) AS (SELECT batch, depth, leaf_count, l FROM start UNION ALL SELECT batch, depth, leaf_count, list_transform(range(len(l) // 2), lambda i: sha256(l[2 * i + 1] || l[2 * i + 2])) FROM t WHERE len(l) > 1) SELECT * FROM t WHERE len(l) = 1),
roots AS (SELECT batch, l[1] AS merkle_root, leaf_count, depth FROM tree)
"""


@query("i1_leaf_hashes", EV_SQL + LEAF_SQL + "SELECT event_id, leaf FROM leaves")
def i1(spark, d):
    return E.leaf_hashes(log_events(spark, d), PARTS).select("event_id", "leaf")


@query("i2_merkle_roots", EV_SQL + ROOT_SQL + "SELECT batch, merkle_root, leaf_count, depth FROM roots")
def i2(spark, d):
    batched = E.leaf_hashes(E.time_batches(log_events(spark, d), seconds=DAY), PARTS)
    return E.merkle_roots(batched.select("batch", "event_id", "leaf"), "batch", ["event_id"])


@query("i3_time_batches", EV_SQL + LEAF_SQL + "SELECT batch, count(*) AS n, min(us) AS first FROM batched GROUP BY batch")
def i3(spark, d):
    return E.time_batches(log_events(spark, d), seconds=DAY).groupBy("batch").agg(F.count("*").alias("n"), F.min("us").alias("first"))


@query("i4_chain_roots", EV_SQL + ROOT_SQL + ", r AS (SELECT *, row_number() OVER (ORDER BY batch) AS n FROM roots), c AS (WITH RECURSIVE t(n, batch, chained) AS (SELECT n, batch, merkle_root FROM r WHERE n = 1 UNION ALL SELECT r.n, r.batch, sha256(t.chained || r.merkle_root) FROM t JOIN r ON r.n = t.n + 1) SELECT * FROM t) SELECT batch, chained FROM c")
def i4(spark, d):
    return anchors(spark, d).select("batch", "chained")


def anchors(spark, d):
    return E.anchor_table(log_events(spark, d), "events", PARTS, seconds=DAY)


@query("i5_anchor_table", EV_SQL + ROOT_SQL + ", g AS (SELECT batch, min(us) AS time_from, max(us) AS time_to FROM batched GROUP BY batch) SELECT batch, time_from, time_to, leaf_count, merkle_root FROM roots JOIN g USING (batch)")
def i5(spark, d):
    return anchors(spark, d).select("batch", "time_from", "time_to", "leaf_count", "merkle_root")


@query("i5_anchor_leaves", EV_SQL + LEAF_SQL + ", n AS (SELECT batch, event_id, leaf, row_number() OVER (PARTITION BY batch ORDER BY event_id) AS p, count(*) OVER (PARTITION BY batch) AS c FROM batched) SELECT batch, count(*)::INT AS kept, sha256(string_agg(leaf, '' ORDER BY event_id)) AS digest FROM n WHERE p <= 10 OR p > c - 10 GROUP BY batch")
def i5b(spark, d):
    """The leaves that anchors keep, here ten of either end, so that some batches have more."""
    batched = E.leaf_hashes(E.time_batches(log_events(spark, d), seconds=DAY), PARTS)
    return E.end_leaves(batched, "batch", "event_id", most=10).select("batch", F.size("leaves").alias("kept"), F.sha2(F.array_join("leaves", ""), 256).alias("digest"))


@query("i6_verify_batches", EV_SQL + LEAF_SQL + ", c AS (SELECT batch, count(*) AS leaf_count, count(*) FILTER (WHERE NOT (batch % 5 = 1 AND event_id % 10 = 0)) AS now_count FROM batched GROUP BY batch) SELECT batch, leaf_count, now_count, CASE WHEN leaf_count <> now_count THEN 'count changed' WHEN batch % 5 = 2 THEN 'tampered' ELSE 'pass' END AS status FROM c")
def i6(spark, d):
    """Rows of some batches are removed or changed before the check."""
    ev = log_events(spark, d)
    changed = E.time_batches(ev, seconds=DAY).filter("not (batch % 5 = 1 and event_id % 10 = 0)").withColumn("host", F.when(F.col("batch") % 5 == 2, "forged").otherwise(F.col("host"))).drop("batch")
    return E.verify_batches(anchors(spark, d), changed, PARTS, seconds=DAY)


@query("i7_unanchored", EV_SQL + f", old AS (SELECT max(us) AS m FROM ev WHERE us < (SELECT max(us) FROM ev) - 48 * {HOUR}) SELECT event_id FROM ev, old WHERE us > m")
def i7(spark, d):
    ev = log_events(spark, d)
    last = ev.agg(F.max("us").alias("m"))
    old = ev.crossJoin(F.broadcast(last)).filter(F.col("us") < F.col("m") - 48 * HOUR).groupBy().agg(F.max("us").alias("time_to"))
    return E.unanchored(ev, old).select("event_id")


@query("i8_evidence_check", EV_SQL + LEAF_SQL + f", g AS (SELECT batch, min(us) AS a, max(us) AS b FROM batched GROUP BY batch), m AS (SELECT e.event_id, least(count(*), 10) AS n FROM ev e JOIN g ON a <= e.us + 2 * {HOUR} AND b >= e.us - 2 * {HOUR} WHERE e.severity = 4 GROUP BY e.event_id) SELECT e.event_id, coalesce(n, 0) AS anchors, true AS chain_intact, n IS NULL AS coverage_gap FROM ev e LEFT JOIN m USING (event_id) WHERE e.severity = 4")
def i8(spark, d):
    return E.evidence_check(log_events(spark, d).filter("severity = 4"), anchors(spark, d))


@query("i9_ioc_check", EV_SQL + f", alerts AS (SELECT * FROM ev WHERE score >= 0.6), bad AS (SELECT DISTINCT dst_ip AS v FROM ev WHERE k % 20 = 3 UNION SELECT DISTINCT src_ip FROM ev WHERE user_id % 17 = 0), f AS (SELECT a.event_id, count(*) AS flows, count(*) FILTER (WHERE f.dst_ip IN (SELECT v FROM bad)) AS bad_flows FROM alerts a JOIN ev f ON f.src_ip = a.src_ip AND f.us BETWEEN a.us - 72 * {HOUR} AND a.us GROUP BY a.event_id) SELECT a.event_id, a.src_ip IN (SELECT v FROM bad) AS own_match, flows, bad_flows, a.src_ip IN (SELECT v FROM bad) OR bad_flows > 0 AS corroborated FROM alerts a JOIN f USING (event_id)")
def i9(spark, d):
    ev = log_events(spark, d)
    bad = ev.filter("k % 20 = 3").select(F.col("dst_ip").alias("value")).union(ev.filter("user_id % 17 = 0").select("src_ip")).distinct()
    return E.ioc_check(ev.filter("score >= 0.6"), ev, bad)


@query("i10_timeline", EV_SQL + f""", alerts AS (SELECT * FROM ev WHERE score >= 0.6), f AS (SELECT 'log' AS kind, 5 AS cap, src_ip, us, event_id FROM ev UNION ALL SELECT 'score', 3, src_ip, us, event_id FROM ev WHERE score >= 0.3),
m AS (SELECT a.event_id, f.kind, f.cap, f.us AS at_us, f.event_id AS entry, row_number() OVER (PARTITION BY a.event_id, f.kind ORDER BY f.us DESC, f.event_id DESC) AS r FROM alerts a JOIN f ON f.src_ip = a.src_ip AND f.us BETWEEN a.us - 24 * {HOUR} AND a.us + {HOUR})
SELECT event_id, string_agg(kind || ':' || entry, ',' ORDER BY at_us, kind, entry) AS timeline, count(*) AS entries FROM m WHERE r <= cap GROUP BY event_id""")
def i10(spark, d):
    ev = log_events(spark, d)
    out = E.timeline(ev.filter("score >= 0.6"), {"log": (ev, 5), "score": (ev.filter("score >= 0.3"), 3)}, "src_ip")
    return out.withColumn("timeline", F.array_join(F.transform("timeline", lambda t: F.concat(t["kind"], F.lit(":"), t["entry_id"].cast("string"))), ","))


FP_SQL = EV_SQL + """, l AS (SELECT host, count(*) FILTER (WHERE k % 2 = 0) AS fp, count(*) FILTER (WHERE k % 2 = 1) AS tp FROM ev WHERE k % 10 < 3 GROUP BY host), v AS (SELECT host, count(*) FILTER (WHERE k % 3 = 0) / 2 AS vfp, count(*) FILTER (WHERE k % 3 <> 0) / 2 AS vtp FROM ev WHERE severity = 4 GROUP BY host),
h AS (SELECT event_id, coalesce(fp, 0) + coalesce(vfp, 0) AS f, coalesce(tp, 0) + coalesce(vtp, 0) AS t FROM ev LEFT JOIN l USING (host) LEFT JOIN v USING (host)), c AS (SELECT event_id, f / (f + t + 1) * (1 - t / greatest(1, t + 1)) AS x FROM h)
"""


@query("i11_fp_history", FP_SQL + "SELECT event_id, round(x, 6) AS fp_confidence, x > 0.6 AS has_fp_history FROM c")
def i11(spark, d):
    ev = log_events(spark, d)
    labels = ev.filter("k % 10 < 3").select("host", F.when(F.col("k") % 2 == 0, "false_positive").otherwise("true_positive").alias("label"))
    verdicts = ev.filter("severity = 4").select("host", F.when(F.col("k") % 3 == 0, "false_positive").otherwise("true_positive").alias("verdict"))
    return E.fp_history(ev.select("event_id", "host"), labels, verdicts, "host").select("event_id", "fp_confidence", "has_fp_history")


VERDICT_SQL = EV_SQL + """, s AS (SELECT event_id, ['NORMAL_BEHAVIOUR', 'CONFIRMED_ATTACK', 'ACTIVE_CAMPAIGN', 'BEHAVIOURAL_ANOMALY', 'ANOMALOUS_PATTERN', 'OTHER'][k % 6 + 1] AS f, score2 AS c, k % 2 = 0 AS ver, k % 9 <> 0 AS ok, k % 2 = 1 AS gap, k % 5 < 2 AS ioc, k % 13 = 0 AS fp, score3 AS fpc, k % 4 <> 0 AS coh FROM ev),
w AS (SELECT *, least(greatest(c * (0.4 + 0.2 * CASE WHEN ver AND ok THEN 1 WHEN gap AND ok THEN 0.5 ELSE 0 END + 0.2 * ioc::INT + 0.1 * (1 - fpc) + 0.1 * coh::INT), 0), 1) AS x FROM s)
"""
DEF_SQL, AMB_SQL = "f IN ('CONFIRMED_ATTACK', 'ACTIVE_CAMPAIGN')", "f IN ('BEHAVIOURAL_ANOMALY', 'ANOMALOUS_PATTERN')"


@query("i12_verdict", VERDICT_SQL + f"""SELECT event_id, CASE WHEN f = 'NORMAL_BEHAVIOUR' OR (fp AND NOT {DEF_SQL}) THEN 'false_positive' WHEN ver AND NOT ok THEN 'inconclusive' WHEN {DEF_SQL} OR ({AMB_SQL} AND c >= 0.6 AND ioc) THEN 'true_positive' ELSE 'inconclusive' END AS verdict,
round(CASE WHEN f = 'NORMAL_BEHAVIOUR' THEN greatest(0.7, 1 - c) WHEN fp AND NOT {DEF_SQL} THEN fpc WHEN ver AND NOT ok THEN 0.5 WHEN {DEF_SQL} OR ({AMB_SQL} AND c >= 0.6) THEN x WHEN {AMB_SQL} THEN c * 0.8 ELSE c * 0.7 END + 1e-9, 6)::DOUBLE AS confidence,
CASE WHEN f = 'NORMAL_BEHAVIOUR' OR (fp AND NOT {DEF_SQL}) THEN 'P4' WHEN ver AND NOT ok THEN 'P2' WHEN {DEF_SQL} THEN CASE WHEN (c >= 0.8 AND ioc) OR f = 'ACTIVE_CAMPAIGN' THEN 'P1' ELSE 'P2' END WHEN {AMB_SQL} AND c >= 0.6 AND ioc THEN 'P2' ELSE 'P3' END AS priority FROM w""")
def i12(spark, d):
    k = F.col("k")
    finding = F.element_at(F.array(*map(F.lit, ("NORMAL_BEHAVIOUR", "CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN", "BEHAVIOURAL_ANOMALY", "ANOMALOUS_PATTERN", "OTHER"))), k % 6 + 1)
    v = E.verdict(finding, F.col("score2"), k % 2 == 0, k % 9 != 0, k % 2 == 1, k % 5 < 2, k % 13 == 0, F.col("score3"), k % 4 != 0)
    return log_events(spark, d).select("event_id", v.alias("v")).select("event_id", "v.verdict", (F.col("v.confidence") + 1e-9).alias("confidence"), "v.priority")


@query("i13_calibrate_confidence", VERDICT_SQL + "SELECT event_id, round(least(greatest(c * (0.4 + 0.2 * ver::INT + 0.2 * ioc::INT + 0.1 * (1 - fpc) + 0.1 * coh::INT), 0), 1) + 1e-9, 6)::DOUBLE AS confidence FROM w")
def i13(spark, d):
    k, one = F.col("k"), lambda c: F.when(c, 1.0).otherwise(0.0)
    weighed = E.calibrate_confidence(F.col("score2"), one(k % 2 == 0), one(k % 5 < 2), F.col("score3"), one(k % 4 != 0))
    return log_events(spark, d).select("event_id", (weighed + 1e-9).alias("confidence"))


@query("i14_skip_negative", VERDICT_SQL + "SELECT event_id FROM w WHERE f <> 'NORMAL_BEHAVIOUR'")
def i14(spark, d):
    finding = F.element_at(F.array(*map(F.lit, ("NORMAL_BEHAVIOUR", "CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN", "BEHAVIOURAL_ANOMALY", "ANOMALOUS_PATTERN", "OTHER"))), F.col("k") % 6 + 1)
    return E.skip_negative(log_events(spark, d).withColumn("finding_type", finding)).select("event_id")


@query("i15_verified_graph", EV_SQL + "SELECT event_id, 2 + (k % 2 = 0)::INT AS nodes FROM ev")
def i15(spark, d):
    nodes = F.array(F.struct(F.col("host").alias("id"), F.lit("host").alias("kind")))
    graph = E.verified_graph(nodes, {"evidence": F.col("host"), "ioc": F.when(F.col("k") % 2 == 0, 1)})
    return log_events(spark, d).select("event_id", F.size(graph).alias("nodes"))


@query("i16_chain_listing", EV_SQL + LEAF_SQL + "SELECT batch, count(*) AS leaf_count FROM batched GROUP BY batch ORDER BY batch DESC LIMIT 10")
def i16(spark, d):
    return E.chain_listing(anchors(spark, d), 10).select("batch", "leaf_count")


@query("f13_chain_check", EV_SQL + LEAF_SQL + "SELECT DISTINCT batch, true AS chain_ok FROM batched")
def f13(spark, d):
    from logloom.operators.windows import chain_check

    own = anchors(spark, d).select("batch", "table_name", "time_from", F.col("chained").alias("merkle_root"), "prev_root")
    return chain_check(own).select("batch", "chain_ok")


@query("e19_evidence_summary", EV_SQL + LEAF_SQL + ", c AS (SELECT batch, count(*) AS n FROM batched GROUP BY batch) SELECT CAST(sum(n) AS BIGINT) AS leaves, count(*) AS batches, round(avg(n), 6) AS mean_leaves, count(*) FILTER (WHERE batch % 2 = 0) AS verified, round(count(*) FILTER (WHERE batch % 2 = 0) / count(*) * 100, 6) AS verified_rate FROM c")
def e19(spark, d):
    from logloom.operators.rollups import evidence_summary

    return evidence_summary(anchors(spark, d).withColumn("verified", F.col("batch") % 2 == 0))
