"""Queries of window functions and detection (inventory F, G) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from logloom.functions import normalize as N
from logloom.functions import scalar as S
from logloom.operators import detect as G
from logloom.operators import windows as W
from logloom.operators.joins import small
from logloom.operators.scratch import written
from logloom.plans.aggregates import SCORED_SQL, bucket_sql, scored
from logloom.plans.features import ACTION_SQL, WINDOWS_IDS, action_code
from logloom.plans.joins_plans import HOUR
from logloom.plans.registry import query
from logloom.sources.fixtures import EV_SQL, log_events


@query("f1_latest_per_key", EV_SQL + "SELECT host, max_by(event_id, us) AS event_id FROM ev GROUP BY host")
def f1(spark, d):
    return W.latest_per_key(log_events(spark, d), ["host"], "us", "event_id").select("host", "event_id")


@query("f2_latest_per_metric", EV_SQL + "SELECT source, round(max_by(value, us), 6) AS value, max(us) AS us FROM ev GROUP BY source")
def f2(spark, d):
    return W.latest_per_metric(log_events(spark, d), "source", "us", "value")


@query("f3_replacing_final", EV_SQL + "SELECT user_id, k, max(event_id) AS event_id FROM ev GROUP BY user_id, k")
def f3(spark, d):
    return W.latest_per_key(log_events(spark, d), ["user_id", "k"], "us", "event_id").select("user_id", "k", "event_id")


SPAN = 48 * HOUR


ERROR_SQL = "CASE WHEN lower(message) LIKE '%syn%' THEN 'syn_error' WHEN regexp_matches(lower(message), 'rst|reject|drop') THEN 'reject_error' WHEN bytes_out + bytes_in = 0 AND duration_ms < 1 THEN 'syn_error' ELSE 'none' END"


@query("f4_connection_time", EV_SQL + f""", e AS (SELECT *, {ERROR_SQL} AS error FROM logs) SELECT event_id, count(*) OVER p AS conn_count, count(*) OVER s AS same_service, round(count(*) OVER s / count(*) OVER p, 6) AS same_service_rate, round(1 - count(*) OVER s / count(*) OVER p, 6) AS diff_service_rate, round(sum((error = 'syn_error')::INT) OVER p / count(*) OVER p, 6) AS serror_rate, round(sum((error = 'reject_error')::INT) OVER p / count(*) OVER p, 6) AS rerror_rate
FROM e WINDOW p AS (PARTITION BY src_ip, dst_ip ORDER BY us RANGE BETWEEN {SPAN} PRECEDING AND CURRENT ROW), s AS (PARTITION BY src_ip, dst_ip, dst_port ORDER BY us RANGE BETWEEN {SPAN} PRECEDING AND CURRENT ROW)""")
def f4(spark, d):
    return W.connection_features_time(log_events(spark, d), seconds=48 * 3600).select("event_id", "conn_count", "same_service", "same_service_rate", "diff_service_rate", "serror_rate", "rerror_rate")


@query("f5_connection_host", EV_SQL + ", w AS (SELECT event_id, dst_port, list(src_ip) OVER w AS s, list(dst_port) OVER w AS p FROM ev WINDOW w AS (PARTITION BY dst_ip ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT event_id, len(list_distinct(s))::INT AS host_sources, len(list_filter(p, lambda x: x = dst_port))::INT AS host_same_service FROM w")
def f5(spark, d):
    return W.connection_features_host(log_events(spark, d), ["us", "event_id"]).select("event_id", "host_sources", "host_same_service")


@query("f6_connection_rates", EV_SQL + f"SELECT event_id, count(*) OVER f AS fast, count(*) OVER s AS slow, round(least(count(*) OVER f / greatest(count(*) OVER s / 300, 0.01), 100), 6)::DOUBLE AS acceleration FROM ev WINDOW f AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {2 * HOUR} PRECEDING AND CURRENT ROW), s AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {600 * HOUR} PRECEDING AND CURRENT ROW)")
def f6(spark, d):
    return W.connection_rates(log_events(spark, d), "src_ip", fast_s=2 * 3600, slow_s=600 * 3600).select("event_id", "fast", "slow", "acceleration")


@query("f7_port_entropy", EV_SQL + ", w AS (SELECT event_id, list(dst_port) OVER (PARTITION BY src_ip ORDER BY us, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS p FROM ev), u AS (SELECT event_id, unnest(p) AS x, len(p) AS n FROM w), g AS (SELECT event_id, x, n, count(*) AS m FROM u GROUP BY ALL) SELECT event_id, round(abs(sum(m / n * log2(m / n))), 6) AS port_entropy FROM g GROUP BY event_id")
def f7(spark, d):
    return W.port_entropy(log_events(spark, d).select("event_id", "src_ip", "us", "dst_port"), "src_ip", ["us", "event_id"]).select("event_id", F.abs("port_entropy").alias("port_entropy"))


@query("f8_source_novelty", EV_SQL + f"SELECT event_id, coalesce((us - lag(us) OVER (PARTITION BY host, source ORDER BY us, event_id) > 24 * {HOUR})::INT, 1) AS novelty FROM ev")
def f8(spark, d):
    return W.source_novelty(log_events(spark, d), ["host", "source"]).select("event_id", "novelty")


@query("f9_ewma_rates", EV_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY us, event_id) AS n, greatest((us - lag(us) OVER (PARTITION BY usr ORDER BY us, event_id)) / 1e6, 0.001) AS gap FROM ev),
f AS (WITH RECURSIVE t(usr, n, event_id, a, m, s, e) AS (SELECT usr, n, event_id, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, (severity = 4)::INT::DOUBLE FROM r WHERE n = 1
  UNION ALL SELECT r.usr, r.n, r.event_id, t.a * pow(0.5, r.gap / 7200) + 1, t.m * pow(0.5, r.gap / 86400) + 1, t.s * pow(0.5, r.gap / 864000) + 1, t.e * pow(0.5, r.gap / 86400) + (r.severity = 4)::INT FROM t JOIN r ON r.usr = t.usr AND r.n = t.n + 1) SELECT * FROM t)
SELECT event_id, round(a, 6) AS rate_fast, round(m, 6) AS rate_medium, round(s, 6) AS rate_slow, round(e, 6) AS error_rate, round(a / greatest(s, 0.01), 6) AS acceleration FROM f""")
def f9(spark, d):
    ev = log_events(spark, d).select("event_id", "usr", "us", "severity", "event_type")
    return W.ewma_rates(ev, "usr", half_lives=(7200.0, 86400.0, 864000.0)).select("event_id", "rate_fast", "rate_medium", "rate_slow", "error_rate", "acceleration")


@query("f10_unique_actions", EV_SQL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY us, event_id) AS n FROM ev),
f AS (WITH RECURSIVE t(usr, n, event_id, b, acts) AS (SELECT usr, n, event_id, us, [event_type] FROM r WHERE n = 1
  UNION ALL SELECT r.usr, r.n, r.event_id, CASE WHEN r.us - t.b > 24 * {HOUR} THEN r.us ELSE t.b END, CASE WHEN r.us - t.b > 24 * {HOUR} THEN [r.event_type] ELSE list_distinct(list_append(t.acts, r.event_type)) END FROM t JOIN r ON r.usr = t.usr AND r.n = t.n + 1) SELECT * FROM t)
SELECT event_id, len(acts)::INT AS unique_actions FROM f""")
def f10(spark, d):
    ev = log_events(spark, d).select("event_id", "usr", "us", "severity", "event_type")
    return W.ewma_rates(ev, "usr", window_s=86400.0).select("event_id", "unique_actions")


@query("f11_baseline_z", EV_SQL + "SELECT event_id, round(CASE WHEN count(*) OVER w < 10 OR stddev_pop(score) OVER w < 1e-6 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6)::DOUBLE AS z FROM ev WINDOW w AS (PARTITION BY host ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def f11(spark, d):
    return W.running_baseline_z(log_events(spark, d), "host", ["us", "event_id"]).select("event_id", F.col("baseline_z").alias("z"))


@query("f12_cross_host", EV_SQL + f", h AS (SELECT * FROM ev WHERE score >= 0.5) SELECT e.event_id, coalesce(c.n, 0) AS cross_hosts FROM ev e LEFT JOIN (SELECT a.event_id, count(DISTINCT b.host) AS n FROM h a JOIN h b ON b.us BETWEEN a.us - 4 * {HOUR} AND a.us GROUP BY a.event_id) c USING (event_id)")
def f12(spark, d):
    return W.cross_host_count(log_events(spark, d), seconds=4 * 3600).select("event_id", "cross_hosts")


@query("f14_coherent_timeline", EV_SQL + ", o AS (SELECT host, (us < lag(us) OVER (PARTITION BY host ORDER BY md5(event_id::VARCHAR)))::INT AS late FROM ev) SELECT host, count(*) AS n, CAST(coalesce(sum(late), 0) AS BIGINT) AS late, coalesce(sum(late), 0) <= greatest(1, count(*) * 0.05) AS coherent FROM o GROUP BY host")
def f14(spark, d):
    ev = log_events(spark, d).withColumn("arrival", F.md5(F.col("event_id").cast("string")))
    return W.coherent_timeline(ev, ["host"], "arrival", "us")


@query("f15_failure_burst", EV_SQL + f"SELECT host, us // (24 * {HOUR}) AS bucket, count(*) AS n FROM ev WHERE severity >= 3 GROUP BY ALL HAVING count(*) >= 5")
def f15(spark, d):
    return W.bursts(log_events(spark, d).filter("severity >= 3"), ["host"], seconds=86400, least=5)


@query("f16_sustained_alerts", EV_SQL + f""", m AS (SELECT host, us // {HOUR} AS h, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT host, h, n >= 1 AND h % 3 <> 0 AS x FROM m), c AS (SELECT *, sum((x IS DISTINCT FROM p)::INT) OVER (PARTITION BY host ORDER BY h) AS g FROM (SELECT *, lag(x) OVER (PARTITION BY host ORDER BY h) AS p FROM b))
SELECT host, min(h) AS start, max(h) AS "end", count(*) AS points FROM c WHERE x GROUP BY host, g HAVING max(h) - min(h) >= 1""")
def f16(spark, d):
    m = log_events(spark, d).groupBy("host", F.floor(F.col("us") / HOUR).alias("at")).agg(F.count("*").alias("n"))
    return W.sustained_alerts(m, "host", "at", (F.col("n") >= 1) & (F.col("at") % 3 != 0), 1)


@query("f17_psi_trend", EV_SQL + "SELECT source, round(max(score2), 6) AS psi, count(*) AS points, CAST(dense_rank() OVER (ORDER BY max(score2) DESC) AS INTEGER) AS rank FROM ev GROUP BY source")
def f17(spark, d):
    return W.psi_trend(log_events(spark, d), "source", "score2")


@query("g1_features_v6", EV_SQL + f""", e AS (SELECT *, {ERROR_SQL} AS error FROM logs)
SELECT event_id, hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week, severity AS severity_numeric, CASE source WHEN 'nginx' THEN 8 ELSE 1 END AS source_type_numeric,
  least(bytes_out, 1e9)::DOUBLE AS src_bytes, least(bytes_in, 1e9)::DOUBLE AS dst_bytes, round(CASE WHEN duration_ms > 0 THEN 60 / (duration_ms / 1000) ELSE 0 END, 6)::DOUBLE AS event_freq_1m,
  CASE protocol WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 ELSE 1 END AS protocol, dst_port, (user_id % 17 = 0)::INT::DOUBLE AS threat_intel_flag, (duration_ms / 1000)::DOUBLE AS duration,
  round(count(*) OVER s / count(*) OVER p, 6) AS same_srv_rate, round(1 - count(*) OVER s / count(*) OVER p, 6) AS diff_srv_rate,
  round(sum((error = 'syn_error')::INT) OVER p / count(*) OVER p, 6) AS serror_rate, round(sum((error = 'reject_error')::INT) OVER p / count(*) OVER p, 6) AS rerror_rate,
  (count(*) OVER p)::DOUBLE AS count, (count(*) OVER s)::DOUBLE AS srv_count, len(list_distinct(list(src_ip) OVER h))::DOUBLE AS dst_host_count, len(list_filter(list(dst_port) OVER h, lambda x: x = dst_port))::DOUBLE AS dst_host_srv_count
FROM e WINDOW p AS (PARTITION BY src_ip, dst_ip ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW), s AS (PARTITION BY src_ip, dst_ip, dst_port ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW),
  h AS (PARTITION BY dst_ip ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def g1(spark, d):
    ev = W.connection_features_host(W.connection_features_time(log_events(spark, d)), ["us", "event_id"])
    return G.features_v6(ev.withColumn("ioc_match", (F.col("user_id") % 17 == 0).cast("int")))


@query("g2_features_v7")
def g2(spark, d):
    ev = log_events(spark, d)
    ev = ev.withColumn("action_code", action_code(ev)).withColumn("stage", F.element_at(F.create_map(*[F.lit(x) for p in G.STAGE_OF_ACTION.items() for x in p]), F.col("action_code")))
    windows_id, none = F.element_at(F.array(*map(F.lit, WINDOWS_IDS)), F.col("k") % len(WINDOWS_IDS) + 1), F.lit(None).cast("string")
    ev = ev.withColumns({"admin_action": N.admin_action(F.col("message"), windows_id, F.when(F.col("k") % 10 == 3, 10), none, none), "event_risk": N.event_risk(windows_id, F.col("k").cast("double"), F.col("level")), "ioc_match": F.col("user_id") % 17 == 0})
    ev = ev.withColumn("signature", S.mask_tokens(F.coalesce("message", F.lit(""))))
    # written once: each part below reads the few columns it needs, and no part is worked out anew for the next
    base = written(ev.withColumn("_row", F.monotonically_increasing_id()), "features")
    order, of = ["us", "event_id"], lambda *columns: base.select("_row", *columns)
    mined = written(G.merge_signatures(of("signature")), "templates")
    total = mined.agg(F.sum("n").alias("total"))
    rarity = mined.crossJoin(F.broadcast(total)).select("signature", G.template_rarity(F.col("template_count"), F.col("total")).alias("rarity"))
    parts = [
        W.port_entropy(W.connection_rates(of("src_ip", "dst_port", *order), "src_ip"), "src_ip", order).select("_row", "fast", "slow", F.col("acceleration").alias("conn_acceleration"), "port_entropy"),
        W.source_novelty(of("host", "source", *order), ["host", "source"]).select("_row", "novelty"),
        *[W.running_baseline_z(of(key, "score", *order), key, order).select("_row", F.col("baseline_z").alias(f"{key}_baseline_z")) for key in ("host", "usr")],
        W.cross_host_count(of("us", "host", "score"), seconds=900, row="_row").select("_row", "cross_hosts"),
        of("signature").join(small(rarity), "signature", "left").select("_row", "rarity"),
        W.ewma_rates(of("usr", "severity", "event_type", *order), "usr").select("_row", "rate_medium", "error_rate", "unique_actions"),
        W.kill_chain(of("host", "stage", "score", *order), "host", "stage").select("_row", "chain_stage", "chain_velocity"),
    ]
    return G.features_v7(reduce(lambda a, b: a.join(b, "_row", "left"), parts, base.drop("signature")))


FUSE_SQL = """, f AS (SELECT *, 0.8 + 0.04 * (0.8 / 0.92) AS wa, 0.12 + 0.04 * (0.12 / 0.92) AS wb, 0.04 AS wc, (score + score2 + score3) / 3 AS m, (user_id % 17 = 0)::INT AS ioc, CASE WHEN user_id % 3 = 0 THEN 1.2 ELSE 1.0 END AS mult FROM ev),
g AS (SELECT *, score * wa + score2 * wb + score3 * wc AS combined, sqrt(((score - m) * (score - m) + (score2 - m) * (score2 - m) + (score3 - m) * (score3 - m)) / 3) AS std FROM f),
h AS (SELECT *, least((combined + CASE WHEN ioc = 1 THEN 0.15 ELSE 0 END) * CASE WHEN ioc = 1 THEN greatest(mult, 1.5) ELSE mult END, 1.0) AS scaled FROM g),
fused AS (SELECT *, CASE WHEN score2 >= 0.85 AND scaled < 0.42 THEN 0.42 ELSE scaled END AS adjusted FROM h)
"""


def fused(spark, d):
    ev = log_events(spark, d)
    fuse = G.fuse_scores_v6(F.col("score"), F.col("score2"), F.col("score3"), F.lit(0.5), F.lit(0.5), (F.col("user_id") % 17 == 0).cast("int"), F.when(F.col("user_id") % 3 == 0, 1.2).otherwise(1.0))
    return ev.withColumn("f", fuse).select("*", "f.*").drop("f")


@query("g3_fuse_scores_v6", EV_SQL + FUSE_SQL + "SELECT event_id, round(combined, 6) AS combined, round(std, 6) AS std, round(1 - std, 6) AS agreement, round(least(greatest(combined - 1.96 * std, 0), 1), 6)::DOUBLE AS ci_low, round(least(greatest(combined + 1.96 * std, 0), 1), 6)::DOUBLE AS ci_high, round(adjusted, 6)::DOUBLE AS adjusted FROM fused")
def g3(spark, d):
    return fused(spark, d).select("event_id", "combined", "std", "agreement", "ci_low", "ci_high", "adjusted")


@query("g4_route_score", EV_SQL + FUSE_SQL + "SELECT event_id, CASE WHEN user_id % 19 = 0 THEN 'discard' WHEN adjusted >= 0.95 THEN 'escalate' WHEN adjusted >= 0.39 AND std >= 0.3 AND adjusted >= 0.75 THEN 'escalate' WHEN adjusted >= 0.39 THEN 'monitor' ELSE 'discard' END AS action FROM fused")
def g4(spark, d):
    return fused(spark, d).select("event_id", G.route_score(F.col("adjusted"), F.col("std"), F.lit(0.39), F.lit(0.95), F.col("user_id") % 19 == 0).alias("action"))


STAGE_SQL = f"CASE {ACTION_SQL} WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 7 THEN 1 WHEN 8 THEN 4 WHEN 9 THEN 3 WHEN 10 THEN 5 WHEN 11 THEN 4 ELSE 0 END"


@query("g5_kill_chain", EV_SQL + f""", r AS (SELECT event_id, host, us / 1e6 AS tm, score2, {STAGE_SQL} AS step, row_number() OVER (PARTITION BY host ORDER BY us, event_id) AS n FROM logs),
f AS (WITH RECURSIVE t(host, n, event_id, last, stage, times) AS (
  SELECT host, n, event_id, tm, CASE WHEN score2 > 0.3 THEN step ELSE 0 END, CASE WHEN score2 > 0.3 AND step > 0 THEN [0.0::DOUBLE] ELSE []::DOUBLE[] END FROM r WHERE n = 1
  UNION ALL SELECT host, n, event_id, CASE WHEN score2 > 0.3 THEN tm ELSE last END, CASE WHEN score2 > 0.3 AND step > s0 THEN step ELSE s0 END, CASE WHEN score2 > 0.3 AND step > s0 THEN list_append(t0, (tm - last)::DOUBLE) ELSE t0 END FROM (
    SELECT r.host, r.n, r.event_id, r.tm, r.score2, r.step, t.last, CASE WHEN r.tm - t.last > 3600 THEN 0 ELSE t.stage END AS s0, CASE WHEN r.tm - t.last > 3600 THEN []::DOUBLE[] ELSE t.times END AS t0 FROM t JOIN r ON r.host = t.host AND r.n = t.n + 1)) SELECT * FROM t)
SELECT event_id, stage AS chain_stage, round(CASE WHEN len(times) > 1 THEN 1 / greatest(list_avg(times[-5:]), 1.0) ELSE 0 END, 6)::DOUBLE AS chain_velocity FROM f""")
def g5(spark, d):
    ev = log_events(spark, d)
    stage = F.create_map(*[F.lit(x) for p in G.STAGE_OF_ACTION.items() for x in p])[action_code(ev)]
    rows = ev.select("event_id", "host", "us", F.col("score2").alias("score"), stage.alias("step"))
    return W.kill_chain(rows, "host", "step").select("event_id", "chain_stage", "chain_velocity")


@query("g6_fuse_scores_v7", EV_SQL + """, a AS (SELECT *, k % 6 AS stage, k % 5 AS xh, (k % 7 = 0)::INT AS ioc, score2 * 0.85 + score3 * 0.15 AS b, abs(score2 - score3) AS gap FROM ev),
c AS (SELECT *, b * CASE WHEN stage >= 2 THEN 1 + 0.1 * stage ELSE 1 END * CASE WHEN xh >= 3 THEN 1.2 ELSE 1 END AS r FROM a), e AS (SELECT *, r + CASE WHEN ioc = 1 THEN 0.05 + 0.15 * r ELSE 0 END AS r2, gap > 0.4 AND greatest(score2, score3) > 0.7 AND least(score2, score3) > 0.3 AS split FROM c),
f AS (SELECT *, least(greatest(CASE WHEN split THEN greatest(r2, 0.9 + 0.05 * least(gap, 1)) ELSE r2 END, 0), 1) AS s FROM e)
SELECT event_id, round(s, 6)::DOUBLE AS final_score, CASE WHEN s >= 0.9 THEN 'escalate' WHEN s >= 0.4 THEN 'monitor' ELSE 'discard' END AS label, coalesce(nullif(concat_ws('; ', CASE WHEN stage >= 2 THEN 'chain' END, CASE WHEN xh >= 3 THEN 'cross-host' END, CASE WHEN ioc = 1 THEN 'indicator' END, CASE WHEN split THEN 'disagreement' END), ''), 'none') AS adjustments FROM f""")
def g6(spark, d):
    fuse = G.fuse_scores_v7(F.col("score2"), F.col("score3"), F.col("k") % 6, F.col("k") % 5, (F.col("k") % 7 == 0).cast("int"))
    return log_events(spark, d).select("event_id", fuse.alias("f")).select("event_id", "f.*")


@query("g7_mine_templates")
def g7(spark, d):
    return G.mine_templates(log_events(spark, d))


@query("g8_template_rarity", EV_SQL + "SELECT event_type, round(CASE WHEN t < 100 THEN 0.5 ELSE least(greatest(1 - ln(1 + n) / ln(1 + t), 0), 1) END, 6)::DOUBLE AS rarity FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM ev GROUP BY event_type)")
def g8(spark, d):
    ev = log_events(spark, d)
    total = ev.agg(F.count("*").alias("t"))
    return ev.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("event_type", G.template_rarity(F.col("n"), F.col("t"), 100).alias("rarity"))


DRIFT_SQL = """, r AS (SELECT 'value' AS f, value AS x, user_id % 2 AS side FROM ev UNION ALL SELECT 'score2', score2, user_id % 2 FROM ev),
q AS (SELECT f, list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS e FROM r WHERE side = 0 GROUP BY f),
b AS (SELECT r.f, side, least(len(list_filter(e, lambda y: y <= x)), len(e) - 1) AS bin FROM r JOIN q USING (f) WHERE x >= list_min(e) AND x <= list_max(e)),
s AS (SELECT f, side, bin, count(*) / sum(count(*)) OVER (PARTITION BY f, side) AS p FROM b GROUP BY f, side, bin),
z AS (SELECT coalesce(a.f, c.f) AS f, greatest(coalesce(a.p, 0), 1e-6) AS p, greatest(coalesce(c.p, 0), 1e-6) AS q FROM (SELECT * FROM s WHERE side = 0) a FULL JOIN (SELECT * FROM s WHERE side = 1) c ON a.f = c.f AND a.bin = c.bin)
SELECT f AS feature, round(sum((q - p) * ln(q / p)), 6) AS psi, round(sum(q * ln(q / p)), 6) AS kl, CASE WHEN sum((q - p) * ln(q / p)) >= 0.25 THEN 'critical' WHEN sum((q - p) * ln(q / p)) >= 0.1 THEN 'warning' ELSE 'ok' END AS level FROM z GROUP BY f"""


@query("g9_drift_psi", EV_SQL + DRIFT_SQL)
def g9(spark, d):
    ev = log_events(spark, d)
    return G.drift_psi(ev.filter("user_id % 2 = 0"), ev.filter("user_id % 2 = 1"), ["value", "score2"])


@query("g10_merge_windows", EV_SQL + f", w AS (SELECT host, us - {HOUR} AS s, us + {HOUR} AS e FROM ev WHERE severity = 4), g AS (SELECT *, sum(coalesce((s > m)::INT, 1)) OVER (PARTITION BY host ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, max(e) OVER (PARTITION BY host ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w)) SELECT host, min(s) AS s, max(e) AS e, count(*) AS merged FROM g GROUP BY host, grp")
def g10(spark, d):
    w = log_events(spark, d).filter("severity = 4").select("host", (F.col("us") - HOUR).alias("s"), (F.col("us") + HOUR).alias("e"))
    return W.merge_windows(w, "host", "s", "e")


@query("g11_score_psi", EV_SQL + """, b AS (SELECT range AS bin, (SELECT count(*) FROM ev WHERE user_id % 2 = 0 AND least(floor(score * 10), 9) = range) AS a, (SELECT count(*) FROM ev WHERE user_id % 2 = 1 AND least(floor(score * 10), 9) = range) AS c FROM range(10)), p AS (SELECT a / sum(a) OVER () + 1e-6 AS p, c / sum(c) OVER () + 1e-6 AS q FROM b)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi, CASE WHEN sum((q - p) * ln(q / p)) >= 0.25 THEN 'critical' WHEN sum((q - p) * ln(q / p)) >= 0.1 THEN 'warning' ELSE 'ok' END AS level FROM p""")
def g11(spark, d):
    ev = log_events(spark, d)
    return G.score_psi(ev.filter("user_id % 2 = 0"), ev.filter("user_id % 2 = 1"))


@query("g12_symmetric_drift", EV_SQL + """, r AS (SELECT 'value' AS f, value AS x, user_id % 2 AS side FROM ev UNION ALL SELECT 'score3', score3, user_id % 2 FROM ev), s AS (SELECT f, min(x) AS lo, max(x) AS hi, avg(x) FILTER (WHERE side = 0) AS m0, avg(x) FILTER (WHERE side = 1) AS m1, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM r GROUP BY f),
b AS (SELECT f, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin, n0, n1, m0, m1, count(*) FILTER (WHERE side = 0) / any_value(n0) + 1e-6 AS p, count(*) FILTER (WHERE side = 1) / any_value(n1) + 1e-6 AS q FROM r JOIN s USING (f) GROUP BY f, least(floor((x - lo) / (hi - lo) * 10), 9), n0, n1, m0, m1)
SELECT f AS feature, round(sum(p * ln(p / q)) / 2 + sum(q * ln(q / p)) / 2, 6) AS kl, round(abs(any_value(m1) - any_value(m0)), 6) AS mean_shift, sum(p * ln(p / q)) / 2 + sum(q * ln(q / p)) / 2 > 0.1 AS drift FROM b GROUP BY f""")
def g12(spark, d):
    ev = log_events(spark, d)
    return G.symmetric_drift(ev.filter("user_id % 2 = 0"), ev.filter("user_id % 2 = 1"), ["value", "score3"])


@query("g13_calibrate_thresholds", EV_SQL + """, r AS (SELECT CAST(least(floor(score3 * 100), 99) AS INT) AS b, (severity >= 3)::INT AS y FROM ev), h AS (SELECT b, sum(y) AS p, sum(1 - y) AS n FROM r GROUP BY b), g AS (SELECT a.range + 10 AS lo, c.range + 50 AS hi FROM range(45) a, range(45) c WHERE a.range + 10 < c.range + 50),
s AS (SELECT lo, hi, sum(p) FILTER (WHERE b >= lo) AS tp, sum(n) FILTER (WHERE b >= lo) AS fp, sum(p + n) FILTER (WHERE b >= lo AND b < hi) AS mid, sum(p) AS pp, sum(n) AS nn FROM g, h GROUP BY lo, hi)
SELECT (lo / 100)::DOUBLE AS suspicious, (hi / 100)::DOUBLE AS anomalous, round(v, 6)::DOUBLE AS value FROM (SELECT lo, hi, round(0.40 * tp / pp + 0.25 * tp / pp + 0.20 * tp / (tp + fp) + 0.10 * (1 - mid / (pp + nn)) + 0.05 * (1 - fp / nn), 9) AS v FROM s) ORDER BY v DESC, lo, hi LIMIT 1""")
def g13(spark, d):
    return G.calibrate_thresholds(log_events(spark, d).withColumn("label", (F.col("severity") >= 3).cast("int")), score="score3")


@query("g14_best_f1", EV_SQL + ", b AS (SELECT score2 AS t, sum((severity >= 3)::INT) AS p, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT t, sum(p) OVER w AS tp, sum(n) OVER w AS fl, sum(p) OVER () AS pp FROM b WINDOW w AS (ORDER BY t DESC)) SELECT round(t, 6) AS threshold, round(f, 6) AS f1 FROM (SELECT t, round(2 * tp / (fl + pp), 9) AS f FROM c) ORDER BY f DESC, t LIMIT 1")
def g14(spark, d):
    return G.best_f1_threshold(log_events(spark, d).withColumn("label", (F.col("severity") >= 3).cast("int")), score="score2")


@query("g15_percentile_thresholds", EV_SQL + ", q AS (SELECT quantile_cont(score, 0.95) FILTER (WHERE severity < 3) AS s, quantile_cont(score, 0.5) FILTER (WHERE severity >= 3) AS a FROM ev) SELECT round(CASE WHEN s >= a THEN (s + a) / 2 - 0.05 ELSE s END, 6) AS suspicious, round(CASE WHEN s >= a THEN (s + a) / 2 + 0.05 ELSE a END, 6) AS anomalous FROM q")
def g15(spark, d):
    return G.percentile_thresholds(log_events(spark, d).withColumn("label", (F.col("severity") >= 3).cast("int")))


@query("g16_pseudo_labels", EV_SQL + "SELECT event_id, CASE WHEN score >= 0.8 THEN 1 ELSE 0 END AS pseudo_label FROM ev WHERE score >= 0.8 OR score <= 0.2")
def g16(spark, d):
    return G.pseudo_labels(log_events(spark, d)).select("event_id", "pseudo_label")


@query("g16_replay_buffer", EV_SQL + f"SELECT event_id FROM ev WHERE (score >= 0.8 OR score <= 0.2) AND us > (SELECT max(us) FROM ev) - 24 * {HOUR} ORDER BY us DESC, event_id DESC LIMIT 50000")
def g16b(spark, d):
    ev = log_events(spark, d)
    return G.replay_buffer(ev, F.lit(ev.agg(F.max("us")).first()[0])).select("event_id")


@query("h1_alert_gate", EV_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY host, source ORDER BY us, event_id) AS n FROM ev WHERE score2 >= 0.8),
f AS (WITH RECURSIVE t(host, source, n, event_id, last, keep) AS (SELECT host, source, n, event_id, us, true FROM r WHERE n = 1
  UNION ALL SELECT r.host, r.source, r.n, r.event_id, CASE WHEN r.us - t.last >= 86400000000 THEN r.us ELSE t.last END, r.us - t.last >= 86400000000 FROM t JOIN r ON r.host = t.host AND r.source = t.source AND r.n = t.n + 1) SELECT * FROM t)
SELECT event_id FROM f WHERE keep""")
def h1(spark, d):
    ev = log_events(spark, d).select("event_id", "host", "source", "us", F.col("score2").alias("score"))
    return W.alert_gate(ev, ["host", "source"], quiet_s=86400.0).select("event_id")


@query("e7_template_counts", EV_SQL + f"SELECT event_type AS template, source, count(*) AS n, min({bucket_sql(60)}) AS first_seen, max({bucket_sql(60)}) AS last_seen FROM ev GROUP BY ALL")
def e7(spark, d):
    from logloom.operators.rollups import template_counts, time_bucket

    return template_counts(log_events(spark, d).select(F.col("event_type").alias("template"), "source", time_bucket(F.col("ts"), 60).alias("ts")))


@query("e7_mined_templates")
def e7_mined(spark, d):
    """Rows, first and last time of every mined template and source."""
    from logloom.operators.rollups import template_counts, time_bucket

    ev = log_events(spark, d)
    return template_counts(G.templated(ev, G.mine_templates(ev)).select("template", "source", time_bucket(F.col("ts"), 60).alias("ts")))
