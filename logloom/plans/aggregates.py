"""Queries of the aggregations and roll-ups (inventory E, K) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions.normalize import first_match
from logloom.operators import rollups as R
from logloom.plans.registry import query
from logloom.sources.fixtures import EV_SQL, TECHNIQUE, log_events

ACTION_SQL = "CASE WHEN score >= 0.95 THEN 'escalate' WHEN score >= 0.39 THEN 'monitor' ELSE 'discard' END"
SCORED_SQL = EV_SQL + f", scored AS (SELECT *, {ACTION_SQL} AS action FROM ev)\n"
AS_OF_SQL = "(SELECT max(ts) + INTERVAL 1 SECOND FROM ev)"


def bucket_sql(seconds: int, ts: str = "ts") -> str:
    return f"(CAST(floor(epoch_us({ts}) / 1000000 / {seconds}) AS BIGINT) * {seconds} * 1000000)"


def scored(spark, d):
    action = first_match([(F.col("score") >= 0.95, F.lit("escalate")), (F.col("score") >= 0.39, F.lit("monitor"))], F.lit("discard"))
    return log_events(spark, d).withColumn("action", action)


def with_as_of(df):
    """``df`` and its newest time plus a second, as a one-row frame's column."""
    last = df.agg((F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("as_of"))
    return df.crossJoin(F.broadcast(last))


def as_of_of(df):
    return F.lit(df.agg((F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("x")).first()[0]).cast("timestamp_ntz")


FEEDS_SQL = """SELECT {b} AS bucket, source, level, count(*) AS events FROM (
  SELECT ts, source, level FROM ev UNION ALL SELECT ts, source, event_type FROM ev WHERE severity >= 2
  UNION ALL SELECT ts, 'process', CASE WHEN severity >= 3 THEN 'SUSPICIOUS' ELSE 'NORMAL' END FROM ev WHERE k % 2 = 0
  UNION ALL SELECT ts, protocol, direction FROM ev WHERE k % 2 = 1) GROUP BY ALL"""


def feeds(ev):
    return [
        (ev, F.col("source"), F.col("level")),
        (ev.filter("severity >= 2"), F.col("source"), F.col("event_type")),
        (ev.filter("k % 2 = 0"), F.lit("process"), F.when(F.col("severity") >= 3, "SUSPICIOUS").otherwise("NORMAL")),
        (ev.filter("k % 2 = 1"), F.col("protocol"), F.col("direction")),
    ]


@query("e1_events_per_minute", EV_SQL + FEEDS_SQL.format(b=bucket_sql(60)))
def e1(spark, d):
    return R.events_per_bucket(feeds(log_events(spark, d)))


@query("e2_events_per_10s", EV_SQL + f"SELECT {bucket_sql(10)} AS bucket, source, CAST(NULL AS VARCHAR) AS level, count(*) AS events FROM ev GROUP BY ALL")
def e2(spark, d):
    return R.events_per_bucket([(log_events(spark, d), F.col("source"), F.lit(None))], seconds=10)


@query("e3_severity_hourly", EV_SQL + f"SELECT {bucket_sql(3600)} AS hour, event_type AS category, severity, count(*) AS events FROM ev GROUP BY ALL")
def e3(spark, d):
    return R.severity_hourly(log_events(spark, d).withColumnRenamed("event_type", "category"))


@query("e4_entity_frequency", EV_SQL + f"SELECT {bucket_sql(60)} AS minute, src_ip, usr, host, count(*) AS events, count(DISTINCT event_type) AS unique_actions, min(severity) AS min_severity, max(severity) AS max_severity FROM ev GROUP BY ALL")
def e4(spark, d):
    return R.entity_frequency(log_events(spark, d), ["src_ip", "usr", "host"], "event_type")


@query("e5_entity_hour_baseline", EV_SQL + """, daily AS (SELECT usr, host, CAST(ts AS DATE) AS d, hour(ts) AS hour, count(*) AS n FROM ev GROUP BY ALL)
SELECT usr, host, CAST(hour AS INTEGER) AS hour, count(*) AS days, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * n) AS BIGINT) AS squares,
  round(avg(n), 6) AS mean, round(sqrt(greatest(sum(n * n) / count(*) - (sum(n) / count(*)) * (sum(n) / count(*)), 0)), 6) AS std FROM daily GROUP BY usr, host, hour""")
def e5(spark, d):
    return R.entity_hour_baseline(log_events(spark, d), ["usr", "host"])


@query("e6_score_rollup", SCORED_SQL + f"SELECT {bucket_sql(3600)} AS hour, source, action, count(*) AS n, round(sum(score), 6) AS score_sum, round(max(score), 6) AS score_max FROM scored GROUP BY ALL")
def e6(spark, d):
    return R.score_rollup(scored(spark, d))


@query("e8_merge_rollup", EV_SQL + f"SELECT {bucket_sql(60)} AS minute, src_ip, count(*) AS events, min(severity) AS min_severity, max(severity) AS max_severity FROM ev GROUP BY ALL")
def e8(spark, d):
    """Partial roll-ups of two halves, merged, are the roll-up of the whole."""
    ev = log_events(spark, d)
    part = lambda df: R.entity_frequency(df, ["src_ip"], "event_type").drop("unique_actions")
    return R.merge_rollup(part(ev.filter("k < 50")), part(ev.filter("k >= 50")), ["minute", "src_ip"], sums=["events"], mins=["min_severity"], maxs=["max_severity"])


@query("e9_rollup_staleness", EV_SQL + f"""SELECT t AS "table", (epoch_us(a) - epoch_us(m)) // 1000000 AS age_s, (epoch_us(a) - epoch_us(m)) // 1000000 > 300 AS stale FROM (
  SELECT 'security' AS t, max(ts) AS m, {AS_OF_SQL} AS a FROM ev WHERE severity >= 2 UNION ALL SELECT 'network', max(ts), {AS_OF_SQL} FROM ev WHERE k % 50 = 1)""")
def e9(spark, d):
    ev = log_events(spark, d)
    return R.rollup_staleness({"security": ev.filter("severity >= 2"), "network": ev.filter("k % 50 = 1")}, as_of_of(ev))


@query("e10_table_counts", """SELECT 'events' AS "table", count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def e10(spark, d):
    return R.table_counts({t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("events", "orders", "lineitem")})


@query("e10_total_events", "SELECT CAST((SELECT count(*) FROM events) + (SELECT count(*) FROM orders) AS BIGINT) AS total")
def e10b(spark, d):
    return R.table_counts({t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("events", "orders")}).agg(F.sum("n").alias("total"))


@query("e11_ingest_rate", EV_SQL + f"""SELECT round(coalesce(nullif(count(*) FILTER (WHERE s >= m - 60 AND s < m) / 60.0, 0), nullif(count(*) FILTER (WHERE s >= n - 3600 AND s < n) / 3600.0, 0), count(*) / greatest(max(s) - min(s), 1)), 6)::DOUBLE AS events_per_s
FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch({AS_OF_SQL})) AS BIGINT) AS n, CAST(floor(epoch({AS_OF_SQL}) / 60) AS BIGINT) * 60 AS m FROM ev)""")
def e11(spark, d):
    ev = log_events(spark, d)
    return R.ingest_rate(ev, as_of_of(ev))


@query("e12_severity_counts", EV_SQL + "SELECT severity, count(*) AS n FROM ev GROUP BY ALL")
def e12(spark, d):
    return R.count_by(log_events(spark, d), ["severity"])


@query("e12_top_sources", EV_SQL + "SELECT source, count(*) AS n FROM ev GROUP BY ALL ORDER BY n DESC, source LIMIT 10")
def e12b(spark, d):
    return R.count_by(log_events(spark, d), ["source"], 10)


@query("e12_category_counts", EV_SQL + "SELECT event_type, count(*) AS n FROM ev GROUP BY ALL")
def e12c(spark, d):
    return R.count_by(log_events(spark, d), ["event_type"])


@query("e12_timeline", EV_SQL + f"SELECT {bucket_sql(3600)} AS hour, count(*) AS n FROM ev GROUP BY ALL")
def e12d(spark, d):
    return R.count_by(log_events(spark, d).withColumn("hour", R.time_bucket(F.col("ts"), 3600)), ["hour"])


@query("e13_technique_counts", EV_SQL + "SELECT technique, count(*) AS n, max(severity) AS max_severity FROM ev GROUP BY ALL")
def e13(spark, d):
    return R.technique_counts(log_events(spark, d))


@query("e13_technique_timeline", EV_SQL + f"SELECT {bucket_sql(3600)} AS hour, technique, count(*) AS n FROM ev GROUP BY ALL")
def e13b(spark, d):
    return R.technique_timeline(log_events(spark, d))


@query("e14_tactic_heatmap", EV_SQL + "SELECT tactic, count(DISTINCT technique) AS techniques, count(*) AS alerts FROM ev GROUP BY ALL")
def e14(spark, d):
    return R.tactic_heatmap(log_events(spark, d))


WEIGHT_SQL = "CASE severity WHEN 4 THEN 25 WHEN 3 THEN 10 WHEN 2 THEN 4 WHEN 1 THEN 1 ELSE 0 END"


@query("e15_risky_entities", EV_SQL + f"""SELECT kind, entity, CAST(sum({WEIGHT_SQL}) AS BIGINT) AS risk, count(*) AS events FROM (SELECT 'user' AS kind, usr AS entity, severity FROM ev UNION ALL SELECT 'host', host, severity FROM ev) GROUP BY kind, entity ORDER BY risk DESC, kind, entity LIMIT 8""")
def e15(spark, d):
    return R.risky_entities(log_events(spark, d), {"user": "usr", "host": "host"})


@query("e16_risk_score", EV_SQL + f"SELECT round(sum({WEIGHT_SQL}) / (count(*) * 25) * 100, 6) AS risk FROM ev")
def e16(spark, d):
    return R.risk_score(log_events(spark, d))


@query("e16_risk_trend", EV_SQL + f"""SELECT a AS now, b AS before, round(CASE WHEN b > 0 THEN (a - b) / b * 100 ELSE 0 END, 6)::DOUBLE AS trend FROM (
  SELECT count(*) FILTER (WHERE severity >= 3 AND age >= 0 AND age < 604800) AS a, count(*) FILTER (WHERE severity >= 3 AND age >= 604800 AND age < 1209600) AS b
  FROM (SELECT severity, CAST(floor(epoch({AS_OF_SQL})) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS age FROM ev))""")
def e16b(spark, d):
    ev = log_events(spark, d)
    return R.risk_trend(ev, as_of_of(ev), 604800)


@query("e17_mttr", EV_SQL + "SELECT round(avg(span), 6) AS mttr_s FROM (SELECT event_type, count(*) AS n, max(CAST(floor(epoch(ts)) AS BIGINT)) - min(CAST(floor(epoch(ts)) AS BIGINT)) AS span FROM ev WHERE severity >= 3 GROUP BY 1 HAVING count(*) >= 2)")
def e17(spark, d):
    return R.mttr(log_events(spark, d).withColumnRenamed("event_type", "category"))


@query("e18_ioc_table", EV_SQL + "SELECT src_ip, source, technique, tactic, count(*) AS n, max(severity) AS max_severity, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen FROM ev GROUP BY ALL")
def e18(spark, d):
    return R.ioc_table(log_events(spark, d))


@query("e20_verdict_breakdown", EV_SQL + "SELECT count(*) FILTER (WHERE v = 'true_positive') AS tp, count(*) FILTER (WHERE v = 'false_positive') AS fp, round(count(*) FILTER (WHERE v = 'true_positive') / count(*) FILTER (WHERE v <> 'open'), 6) AS precision FROM (SELECT CASE WHEN severity = 4 THEN 'true_positive' WHEN severity = 3 THEN 'false_positive' ELSE 'open' END AS v FROM ev)")
def e20(spark, d):
    verdict = F.when(F.col("severity") == 4, "true_positive").when(F.col("severity") == 3, "false_positive").otherwise("open")
    return R.verdict_breakdown(log_events(spark, d).withColumn("verdict", verdict))


@query("e21_score_histogram", EV_SQL + "SELECT CAST(floor(score * 100 / 10) * 10 AS INTEGER) AS bucket, count(*) AS n FROM ev GROUP BY ALL")
def e21(spark, d):
    return R.score_histogram(log_events(spark, d))


@query("e22_model_score_stats", SCORED_SQL + """SELECT model, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(avg((s > 0.5)::INT), 6) AS over_half, round(avg((action = 'escalate')::INT), 6) AS escalate_rate, round(avg((action = 'discard')::INT), 6) AS discard_rate
FROM (SELECT 'score' AS model, score AS s, action FROM scored UNION ALL SELECT 'score2', score2, action FROM scored UNION ALL SELECT 'score3', score3, action FROM scored) GROUP BY model""")
def e22(spark, d):
    return R.model_score_stats(scored(spark, d), ["score", "score2", "score3"])


@query("e23_escalation_parity", SCORED_SQL + "SELECT count(*) AS sources, round(min(r), 6) AS least, round(max(r), 6) AS greatest, round(CASE WHEN max(r) > 0 THEN min(r) / max(r) ELSE 1 END, 6) AS parity FROM (SELECT source, avg((action = 'escalate')::INT) AS r FROM scored GROUP BY source HAVING count(*) >= 20)")
def e23(spark, d):
    return R.escalation_parity(scored(spark, d))


@query("e24_equalized_odds", EV_SQL + """SELECT *, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6)::DOUBLE AS tpr, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6)::DOUBLE AS fpr FROM (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE severity >= 3 AND score2 >= 0.5) AS tp, count(*) FILTER (WHERE severity < 3 AND score2 >= 0.5) AS fp, count(*) FILTER (WHERE severity >= 3 AND score2 < 0.5) AS fn, count(*) FILTER (WHERE severity < 3 AND score2 < 0.5) AS tn FROM ev GROUP BY source HAVING count(*) >= 5)""")
def e24(spark, d):
    return R.equalized_odds(log_events(spark, d), F.col("severity") >= 3, F.col("score2") >= 0.5)


@query("e25_agent_radar", SCORED_SQL + "SELECT round(avg(score), 6) AS confidence, round(1 - (max(score) - min(score)), 6) AS evenness, round(1 - avg(abs(score2 - score3)), 6) AS agreement, round(avg((action = 'escalate')::INT), 6) AS escalated FROM scored")
def e25(spark, d):
    return R.agent_radar(scored(spark, d))


@query("e26_rule_coverage", EV_SQL + "SELECT count(*) AS seen, count(*) FILTER (WHERE technique IN ('T1110', 'T1046')) AS covered, round(count(*) FILTER (WHERE technique IN ('T1110', 'T1046')) / count(*), 6) AS coverage FROM (SELECT DISTINCT technique FROM ev)")
def e26(spark, d):
    rules = spark.createDataFrame([(t,) for t in (TECHNIQUE["error"], TECHNIQUE["click"], "T9999")], "technique string")
    return R.rule_coverage(log_events(spark, d), rules)


def attributions(ev):
    """(us, feature, value) of a linear score's five parts."""
    parts = {"score": 0.5 * F.col("score"), "score2": 0.45 * F.col("score2"), "score3": 0.44 * F.col("score3"), "value": F.col("value") / 300, "k": F.col("k") / 220}
    return ev.select("us", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in parts.items()])).alias("_a")).select("us", "_a.*")


STABILITY_SQL = EV_SQL + """, a AS (SELECT us // 86400000000 AS w, unnest([{'f': 'score', 'v': 0.5 * score}, {'f': 'score2', 'v': 0.45 * score2}, {'f': 'score3', 'v': 0.44 * score3}, {'f': 'value', 'v': value / 300}, {'f': 'k', 'v': k / 220}]) AS x FROM ev), m AS (SELECT w, x.f AS f, avg(abs(x.v)) AS mean FROM a GROUP BY ALL),
p AS (SELECT w, lag(w) OVER (ORDER BY w) AS b FROM (SELECT DISTINCT w FROM m)), j AS (SELECT n.w, row_number() OVER (PARTITION BY n.w ORDER BY n.mean DESC, n.f) - row_number() OVER (PARTITION BY n.w ORDER BY o.mean DESC, n.f) AS d FROM m n JOIN p ON p.w = n.w JOIN m o ON o.w = p.b AND o.f = n.f),
stable AS (SELECT w AS "window", count(*) AS features, (1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)))::DOUBLE AS stability FROM j GROUP BY w)
"""


@query("e25_attribution_stability", STABILITY_SQL + 'SELECT "window", features, round(stability, 6) AS stability FROM stable')
def e25_stability(spark, d):
    """Rank agreement of attributions from day to day."""
    rows = attributions(log_events(spark, d)).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return R.attribution_stability(rows, "day")


LABEL_SQL = "CASE WHEN k % 3 = 0 THEN 'true_positive' WHEN user_id % 2 = 0 AND k % 5 = 1 THEN 'true_positive' WHEN k % 7 = 0 THEN 'false_positive' END"


@query("e25_fairness", EV_SQL + f", r AS (SELECT host, count(*) AS n, avg(coalesce(({LABEL_SQL}) = 'true_positive', false)::INT) AS rate FROM ev GROUP BY host HAVING count(*) >= 10) SELECT count(*) AS groups, round(max(rate) - min(rate), 6) AS spread, round(greatest(0, 1 - (max(rate) - min(rate))), 6)::DOUBLE AS fairness FROM r")
def e25_fairness(spark, d):
    return R.true_positive_fairness(labelled_rows(log_events(spark, d)), "host")


def labelled_rows(ev):
    return ev.withColumn("label", F.expr(LABEL_SQL))


@query("e25_radar", STABILITY_SQL + f""", r AS (SELECT host, avg(coalesce(({LABEL_SQL}) = 'true_positive', false)::INT) AS rate FROM ev GROUP BY host HAVING count(*) >= 10), half AS (SELECT (min(us) + max(us)) // 2 AS h FROM ev),
b AS (SELECT range AS bin, (SELECT count(*) FROM ev, half WHERE us < h AND least(floor(score * 10), 9) = range) AS x, (SELECT count(*) FROM ev, half WHERE us >= h AND least(floor(score * 10), 9) = range) AS y FROM range(10)), q AS (SELECT x / sum(x) OVER () + 1e-6 AS p, y / sum(y) OVER () + 1e-6 AS q FROM b)
SELECT 'all' AS agent, 'stability' AS measure, round(avg(stability), 6) AS value FROM stable UNION ALL SELECT 'all', 'drift resistance', round(greatest(0, 1 - sum((q - p) * ln(q / p))), 6) FROM q UNION ALL SELECT 'all', 'fairness', round(greatest(0, 1 - (max(rate) - min(rate))), 6) FROM r
UNION ALL SELECT 'triage', 'confidence', round(avg(score), 6) FROM ev UNION ALL SELECT 'hunter', 'confidence', round(avg(score2), 6) FROM ev WHERE severity >= 3 UNION ALL SELECT 'verifier', 'confidence', round(avg(score3), 6) FROM ev WHERE severity = 4""")
def e25_radar(spark, d):
    from logloom.operators.detect import score_psi

    ev = log_events(spark, d)
    low, high = ev.agg(F.min("us"), F.max("us")).first()
    middle = (low + high) // 2
    agents = {"triage": (ev, "score"), "hunter": (ev.filter("severity >= 3"), "score2"), "verifier": (ev.filter("severity = 4"), "score3")}
    rows = attributions(ev).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return R.radar_rows(agents, R.attribution_stability(rows, "day"), score_psi(ev.filter(F.col("us") < middle), ev.filter(F.col("us") >= middle)), R.true_positive_fairness(labelled_rows(ev), "host"))


@query("e26_rule_severities", EV_SQL + """, rules(technique, severity, status) AS (VALUES ('T1110', 3, 'active'), ('T1110', 4, 'active'), ('T1046', 3, 'active'), ('T9999', 3, 'active'), ('T1041', 2, 'draft')), s AS (SELECT technique, count(*) AS n FROM ev GROUP BY technique)
SELECT severity, count(*) AS rules, count(n) AS fired, coalesce(sum(n), 0)::BIGINT AS events FROM rules LEFT JOIN s USING (technique) WHERE status = 'active' GROUP BY severity""")
def e26_severities(spark, d):
    rules = [("T1110", 3, "active"), ("T1110", 4, "active"), ("T1046", 3, "active"), ("T9999", 3, "active"), ("T1041", 2, "draft")]
    return R.rule_severities(log_events(spark, d), spark.createDataFrame(rules, "technique string, severity int, status string"))


@query("e26_top_categories", EV_SQL + ", c AS (SELECT CASE WHEN k % 50 = 0 THEN '' ELSE event_type || '-' || (k % 9) END AS category FROM ev) SELECT category, count(*) AS n FROM c WHERE category <> '' GROUP BY category ORDER BY n DESC, category LIMIT 10")
def e26_categories(spark, d):
    category = F.when(F.col("k") % 50 == 0, "").otherwise(F.concat_ws("-", "event_type", (F.col("k") % 9).cast("string")))
    return R.top_categories(log_events(spark, d).withColumn("category", category), "category")


@query("e27_investigation_counts", SCORED_SQL + "SELECT count(*) FILTER (WHERE action = 'monitor') AS open, count(*) FILTER (WHERE action = 'escalate') AS completed, count(*) FILTER (WHERE severity = 4) AS critical, count(*) FILTER (WHERE severity = 3) AS high FROM scored")
def e27(spark, d):
    status = F.when(F.col("action") == "monitor", "open").when(F.col("action") == "escalate", "completed")
    return R.investigation_counts(scored(spark, d).withColumn("status", status))


@query("e28_top_talkers", EV_SQL + "SELECT src_ip, dst_ip, count(*) AS n FROM ev GROUP BY ALL ORDER BY n DESC, src_ip, dst_ip LIMIT 20")
def e28(spark, d):
    return R.count_by(log_events(spark, d), ["src_ip", "dst_ip"], 20)


@query("e28_text_hits", EV_SQL + "SELECT source, count(*) AS n FROM logs WHERE message LIKE '%root%' OR message ILIKE '%FAILED%' GROUP BY ALL")
def e28b(spark, d):
    return R.count_by(log_events(spark, d).filter(F.col("message").like("%root%") | F.col("message").ilike("%FAILED%")), ["source"])


@query("e29_host_network_context", EV_SQL + "SELECT host, count(*) AS flows, count(DISTINCT dst_ip) AS destinations, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_port) AS ports FROM ev GROUP BY ALL")
def e29(spark, d):
    return R.host_network_context(log_events(spark, d))


@query("e30_confusion_metrics", EV_SQL + """, r AS (SELECT CASE WHEN severity >= 3 THEN 1 ELSE 0 END AS y, score2 AS s FROM ev), b AS (SELECT s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM r GROUP BY s),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM b WINDOW w AS (ORDER BY s DESC)),
t AS (SELECT sum(p) AS pp, sum(n) AS nn, sum(p) FILTER (WHERE s >= 0.5) AS a, sum(n) FILTER (WHERE s >= 0.5) AS f, sum(n * (tp - p / 2)) AS area, sum(p * tp / (tp + fp)) AS ap FROM c)
SELECT round((a + nn - f) / (pp + nn), 6) AS accuracy, round(a / (a + f), 6) AS precision, round(a / pp, 6) AS recall, round(2 * (a / (a + f)) * (a / pp) / (a / (a + f) + a / pp), 6) AS f1, round(f / nn, 6) AS fpr, round(area / (pp * nn), 6) AS roc_auc, round(ap / pp, 6) AS average_precision FROM t""")
def e30(spark, d):
    return R.confusion_metrics(log_events(spark, d).withColumn("y", (F.col("severity") >= 3).cast("int")), "y", "score2")


@query("e31_dataset_profile", EV_SQL + """SELECT source, n, round(share, 6) AS attack_share, types, round(gap, 6) AS severity_gap, coalesce(gap >= 1, false) AS leak_warning FROM (
  SELECT source, count(*) AS n, avg((k % 3 = 0)::INT) AS share, count(DISTINCT event_type) AS types, avg(severity) FILTER (WHERE k % 3 = 0) - avg(severity) FILTER (WHERE k % 3 <> 0) AS gap FROM ev GROUP BY source)""")
def e31(spark, d):
    return R.dataset_profile(log_events(spark, d).withColumn("y", (F.col("k") % 3 == 0).cast("int")), "source", "y", "event_type", "severity")


@query("e32_dataset_fingerprint")
def e32(spark, d):
    return R.dataset_fingerprint(log_events(spark, d).select("event_id", "us", "value"))


@query("e33_attribution_interactions", EV_SQL + """, a AS (SELECT unnest([{'f': 'bytes', 'v': score}, {'f': 'port', 'v': score2}, {'f': 'rate', 'v': score3}]) AS x, event_id FROM ev),
p AS (SELECT x.x.f AS a, y.x.f AS b, (abs(x.x.v) + abs(y.x.v)) / 2 AS i FROM a x JOIN a y ON x.event_id = y.event_id AND y.x.f > x.x.f)
SELECT a, b, round(count(*) / n, 6) AS rate, round(avg(i), 6) AS importance, round(count(*) / n * avg(i), 6) AS strength FROM p, (SELECT count(*) AS n FROM ev) GROUP BY a, b, n""")
def e33(spark, d):
    lists = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("value")) for f, c in (("bytes", "score"), ("port", "score2"), ("rate", "score3"))])
    return R.attribution_interactions(log_events(spark, d).withColumn("attributions", lists), "attributions")


@query("e34_spc_baseline", EV_SQL + f"SELECT host, src_ip, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS std, count(*) AS buckets FROM (SELECT host, src_ip, {bucket_sql(3600)} AS b, count(*) AS n FROM ev GROUP BY ALL) GROUP BY host, src_ip")
def e34(spark, d):
    return R.spc_baseline(log_events(spark, d), ["host", "src_ip"], seconds=3600)


@query("e35_score_summary", SCORED_SQL + """SELECT source, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS greatest, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95) + 1e-9, 6) AS p95,
  count(*) FILTER (WHERE action = 'escalate') AS escalated, count(*) FILTER (WHERE action = 'monitor') AS monitored, count(*) FILTER (WHERE action = 'discard') AS discarded FROM scored GROUP BY source""")
def e35(spark, d):
    # exact halves at the last place may be rounded either way: both sides are moved off them
    return R.score_summary(scored(spark, d), "source").withColumn("p95", F.col("p95") + 1e-9)


@query("e35_class_separation", EV_SQL + "SELECT round(quantile_cont(score, 0.5) FILTER (WHERE severity >= 3) - quantile_cont(score, 0.5) FILTER (WHERE severity < 3), 6) AS separation FROM ev")
def e35b(spark, d):
    return R.class_separation(log_events(spark, d), F.col("severity") >= 3)


@query("e36_recent_findings", EV_SQL + "SELECT event_id, host, severity FROM ev WHERE severity >= 3 ORDER BY ts DESC, event_id DESC LIMIT 20")
def e36(spark, d):
    return R.newest(log_events(spark, d).filter("severity >= 3"), 20).select("event_id", "host", "severity")


@query("e36_top_scores", EV_SQL + "SELECT event_id, round(score, 6) AS score FROM ev ORDER BY score DESC, event_id LIMIT 20")
def e36b(spark, d):
    return R.top_scores(log_events(spark, d), 20).select("event_id", "score")


@query("e36_report_history", EV_SQL + f"SELECT count(*) AS reports, count(*) FILTER (WHERE CAST(floor(epoch({AS_OF_SQL})) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) < 604800) AS last_week FROM ev")
def e36c(spark, d):
    ev = log_events(spark, d)
    return R.report_history(ev, as_of_of(ev))


@query("e37_host_score_context", SCORED_SQL + "SELECT host, count(*) FILTER (WHERE action = 'escalate') AS escalations, round(avg(score), 6) AS mean, count(*) FILTER (WHERE score >= 0.9) AS high, count(*) FILTER (WHERE score >= 0.8 AND score < 0.9) AS medium FROM scored GROUP BY host")
def e37(spark, d):
    return R.host_score_context(scored(spark, d))


@query("risk_board", EV_SQL + f"""SELECT usr, host, count(*) AS events, count(DISTINCT event_type) AS unique_actions, CAST(sum({WEIGHT_SQL}) AS BIGINT) AS risk, round(CAST(sum(CAST(score AS DECIMAL(18, 9))) AS DOUBLE) / count(*), 6) AS mean_score, max(severity) AS max_severity FROM ev GROUP BY usr, host""")
def risk_board(spark, d):
    """Per entity: activity, distinct actions, weighted severity and mean score."""
    from logloom.functions.scalar import severity_weight

    ev = log_events(spark, d)
    return ev.groupBy("usr", "host").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("unique_actions"), F.sum(severity_weight(F.col("severity"))).alias("risk"), (F.sum(F.col("score").cast("decimal(18,9)")).cast("double") / F.count("*")).alias("mean_score"), F.max("severity").alias("max_severity"))
