"""Queries of streaming, models, data sets and vectors (inventory J, L, M, N, H9) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logloom.operators import detect as G
from logloom.operators import investigate as H
from logloom.operators import ml as M
from logloom.operators import vectors as V
from logloom.plans.aggregates import SCORED_SQL, bucket_sql, scored
from logloom.plans.features import action_code
from logloom.plans import windows_plans  # noqa: F401  (its SQL is that of the batch twins)
from logloom.plans.registry import ORACLE_SQL, query
from logloom.sources.fixtures import EV_SQL, log_events
from logloom.streaming import streams as S
from logloom.streaming import trailing as T


def shared_root(spark) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def streamed(spark, df, transform, mode: str = "append"):
    """The result of a stream over the rows of a frame: written to files, read as a stream to its end.

    All files are one micro-batch, however many: they are not in time order, so of a second batch most rows were late.
    """
    root = shared_root(spark)
    df.write.parquet(f"{root}/in")
    out = transform(spark.readStream.schema(df.schema).parquet(f"{root}/in"))
    S.run_available(out, f"{root}/out", f"{root}/checkpoint", mode)
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def in_turns(df, turns: int, wait_us=None):
    """``df`` with ``turn``: its rows by time, cut into equal spans; ``wait_us`` is how much later each row comes in."""
    low, high = df.agg(F.min("us"), F.max("us")).first()
    came = F.col("us") + (0 if wait_us is None else wait_us)
    place = F.floor((came - F.lit(low or 0)) * turns / F.lit(((high or 0) - (low or 0)) + 1)).cast("int")
    return df.withColumn("turn", F.least(F.coalesce(place, F.lit(0)), F.lit(turns - 1)))


def streamed_in_turns(spark, df, transform, turns: int, mode: str = "append", drop_us: bool = False):
    """As ``streamed``, but the rows of each ``turn`` arrive when those before have been taken in: a micro-batch each, whatever
    the number of files, with the state and the watermark of the one before."""
    root = shared_root(spark)
    for i in range(turns):
        part = df.filter(F.col("turn") == i).drop("turn", *(["us"] if drop_us else []))
        part.write.mode("append").parquet(f"{root}/in")
        out = transform(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
        S.run_available(out, f"{root}/out", f"{root}/checkpoint", mode)
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def turn_sql(turns: int, wait: str = "0") -> str:
    return f"least(((us + {wait} - (SELECT min(us) FROM ev)) * {turns} // ((SELECT max(us) - min(us) FROM ev) + 1))::INT, {turns - 1})"


def timed(ev):
    """With the time as a timestamp, as streams need it for watermarks."""
    return ev.withColumn("at", F.timestamp_micros("us"))


def closed(df):
    """Start of a window in microseconds instead of the window."""
    return df.withColumn("start", F.unix_micros("window.start")).drop("window")


LAST_SQL = "(SELECT max(us) - 600000000 FROM ev)"


@query("j1_tumbling", EV_SQL + f"SELECT start, source, count(*) AS events FROM (SELECT {bucket_sql(3600)} AS start, source FROM ev) GROUP BY ALL HAVING start + 3600000000 <= {LAST_SQL}")
def j1(spark, d):
    """Windows that the watermark has closed at the end of the input."""
    ev = timed(log_events(spark, d)).select("at", "source")
    return closed(streamed(spark, ev, lambda s: S.tumbling_counts(s, "at", ["source"], "1 hour")))


@query("j2_hopping", EV_SQL + f", w AS (SELECT source, unnest([(us // 3600000000 - 1) * 3600000000, us // 3600000000 * 3600000000]) AS start FROM ev) SELECT start, source, count(*) AS events FROM w GROUP BY ALL HAVING start + 7200000000 <= {LAST_SQL}")
def j2(spark, d):
    ev = timed(log_events(spark, d)).select("at", "source")
    return closed(streamed(spark, ev, lambda s: S.hopping_counts(s, "at", ["source"], "2 hours", "1 hour")))


MEASURES = [T.Trailing("n_2s", "count", 2), T.Trailing("n_300s", "count", 300), T.Trailing("actions_300s", "distinct", 300, "event_type"), T.Trailing("errors_600s", "sum", 600, "error"), T.Trailing("same_900s", "same", 900, "event_type")]
SLOT = 14_400_000_000
#: Rows come up to five minutes late, which is less than the watermark allows.
WAIT_SQL = "(('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 300000000)"


def wait_us():
    return F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") % 300_000_000


@query("j2_trailing", EV_SQL + f"""SELECT event_id, count(*) OVER (w RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW)::DOUBLE AS n_2s, count(*) OVER m::DOUBLE AS n_300s, len(list_distinct(list(event_type) OVER m))::DOUBLE AS actions_300s,
  sum((severity = 4)::INT) OVER (w RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW)::DOUBLE AS errors_600s, count(*) OVER (PARTITION BY direction, event_type ORDER BY us RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW)::DOUBLE AS same_900s
FROM ev WINDOW w AS (PARTITION BY direction ORDER BY us), m AS (PARTITION BY direction ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)
QUALIFY (us // {SLOT} + 1) * {SLOT} <= (SELECT max(us) - 600000000 FROM ev)""")
def j2_trailing(spark, d):
    """Exact windows up to each row, of rows that come out of order in four micro-batches; given out when their slot is over."""
    ev = in_turns(timed(log_events(spark, d)).select("event_id", "at", "us", "direction", "event_type", (F.col("severity") == 4).cast("double").alias("error")), 4, wait_us())
    return streamed_in_turns(spark, ev, lambda s: T.trailing_stream(s, ["direction"], MEASURES, slot_s=SLOT / 1_000_000), 4)


@query("j3_sessions", EV_SQL + f""", s AS (SELECT host, us, sum(coalesce((us - p > 3600000000)::INT, 1)) OVER (PARTITION BY host ORDER BY us) AS g FROM (SELECT host, us, lag(us) OVER (PARTITION BY host ORDER BY us) AS p FROM ev))
SELECT min(us) AS start, host, count(*) AS events FROM s GROUP BY host, g HAVING max(us) + 3600000000 <= {LAST_SQL}""")
def j3(spark, d):
    ev = timed(log_events(spark, d)).select("at", "host")
    out = streamed(spark, ev, lambda s: S.idle_sessions(s, "at", ["host"]))
    return out.select(F.unix_micros("session_window.start").alias("start"), "host", "events")


@query("j4_ewma_stream", "SELECT event_id, rate_fast, rate_medium, rate_slow, error_rate FROM (" + ORACLE_SQL["f9_ewma_rates"] + ")")
def j4(spark, d):
    ev = log_events(spark, d).select("event_id", "usr", "us", "severity")
    return streamed(spark, ev, lambda s: S.ewma_stream(s, "usr", (7200.0, 86400.0, 864000.0)))


@query("j5_kill_chain_stream", "SELECT event_id, chain_stage FROM (" + ORACLE_SQL["g5_kill_chain"] + ")")
def j5(spark, d):
    ev = log_events(spark, d)
    step = F.create_map(*[F.lit(x) for p in G.STAGE_OF_ACTION.items() for x in p])[action_code(ev)]
    return streamed(spark, ev.select("event_id", "host", "us", F.col("score2").alias("score"), step.alias("step")), lambda s: S.kill_chain_stream(s, "host"))


@query("j6_baseline_stream", EV_SQL + "SELECT event_id, round(CASE WHEN count(*) OVER w < 10 OR stddev_pop(score) OVER w < 1e-6 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6)::DOUBLE AS z FROM ev WINDOW w AS (PARTITION BY host ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def j6(spark, d):
    ev = log_events(spark, d).select("event_id", "host", "us", "score")
    return streamed(spark, ev, lambda s: S.baseline_stream(s, "host"))


@query("j7_suppress_duplicates", EV_SQL + "SELECT host, k, 1::BIGINT AS n FROM ev GROUP BY host, k")
def j7(spark, d):
    """One row of each key: the span is longer than the input."""
    ev = timed(log_events(spark, d)).select("at", "host", "k")
    return streamed(spark, ev, lambda s: S.suppress_duplicates(s, "at", ["host", "k"], "100 days")).groupBy("host", "k").agg(F.count("*").alias("n"))


#: Rows of every tenth k come a turn and a half later than the others, so most of them are late.
BEHIND = 4 * 86_400_000_000
BEHIND_SQL = f"(CASE WHEN k % 10 = 0 THEN {BEHIND} ELSE 0 END)"
#: CTEs: ``came`` has the turn of each row, ``marks`` the newest row of the turns before each turn, in whole milliseconds.
TURNS_SQL = EV_SQL + f""", came AS (SELECT *, {turn_sql(3, BEHIND_SQL)} AS turn FROM ev),
marks AS (SELECT a.turn, max(b.us) // 1000 * 1000 AS newest FROM (SELECT DISTINCT turn FROM came) a JOIN came b ON b.turn < a.turn GROUP BY a.turn)
"""


def turns_with_late(ev):
    return in_turns(ev, 3, F.when(F.col("k") % 10 == 0, BEHIND).otherwise(0))


@query("j7_redelivered", TURNS_SQL + "SELECT event_id, host FROM came LEFT JOIN marks USING (turn) WHERE newest IS NULL OR us > newest - 300000000")
def j7_redelivered(spark, d):
    """Rows that come twice or, in the next micro-batch, a third time, count once within 300 s; late ones do not count."""
    ev = turns_with_late(timed(log_events(spark, d)).select("event_id", "at", "us", "host", "k"))
    again = ev.filter("k % 5 = 0").unionAll(ev.filter("k % 7 = 0").withColumn("turn", F.least(F.col("turn") + 1, F.lit(2))))
    out = streamed_in_turns(spark, ev.unionAll(again), lambda s: S.suppress_duplicates(s, "at", ["event_id"]), 3)
    return out.select("event_id", "host")


@query("j10_late_side_table", TURNS_SQL + "SELECT turn::BIGINT AS batch, coalesce(us <= newest - 600000000, false) AS late, count(*) AS n, min(event_id) AS first FROM came LEFT JOIN marks USING (turn) GROUP BY ALL")
def j10_late_side_table(spark, d):
    """Rows in time and late ones of three micro-batches, each in its own table and counted once."""
    root = shared_root(spark)
    ev = turns_with_late(log_events(spark, d).select("event_id", "us", "k"))
    for i in range(3):
        part = ev.filter(F.col("turn") == i).drop("turn")
        part.write.mode("append").parquet(f"{root}/in")
        writer = S.route_late(spark.readStream.schema(part.schema).parquet(f"{root}/in"), "us", root)
        writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return S.routed(spark, root).groupBy("batch", "late").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("j9_effectively_once", EV_SQL + "SELECT source, event_type, count(*) AS n FROM ev GROUP BY ALL")
def j9_effectively_once(spark, d):
    """A micro-batch whose writer fails after it has written is taken in again and counts once, without removing duplicates."""
    root = shared_root(spark)
    ev = in_turns(log_events(spark, d).select("event_id", "ts", "us", "source", "event_type"), 2)
    failed = []

    def step(batch, batch_id):
        S.append_sink(batch, batch_id, f"{root}/out")
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise ConnectionError("lost after the write")

    for i in (0, 1, 1):
        if i == 0 or not failed:
            part = ev.filter(F.col("turn") == i).drop("turn")
            part.write.mode("append").parquet(f"{root}/in")
        run = spark.readStream.schema(part.schema).parquet(f"{root}/in").writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except StreamingQueryException:
            if failed != [1]:
                raise
    return spark.read.parquet(f"{root}/out").groupBy("source", "event_type").agg(F.count("*").alias("n"))


@query("j13_metrics_stream", EV_SQL + f""", came AS (SELECT *, {turn_sql(3)} AS turn FROM ev), b AS (SELECT turn::BIGINT AS batch, count(*) AS n, count(*) FILTER (WHERE severity = 4) AS errors, avg(score) AS mean, min(us) AS oldest, max(us) AS newest FROM came GROUP BY turn),
m AS (SELECT *, max(newest) OVER (ORDER BY batch) AS so_far, first(mean) OVER (ORDER BY batch) AS base FROM b)
SELECT batch, x.metric, round(x.value, 6) AS value FROM (SELECT batch, unnest([{{'metric': 'rows', 'value': n::DOUBLE}}, {{'metric': 'errors', 'value': errors::DOUBLE}}, {{'metric': 'mean_score', 'value': mean}}, {{'metric': 'drift_score', 'value': abs(mean - base)}}, {{'metric': 'lag_s', 'value': (so_far - oldest) / 1e6}}]) AS x FROM m)""")
def j13_metrics_stream(spark, d):
    """What three micro-batches report of themselves, from the table that the listener appends to; rates are in it, but hang on
    the machine."""
    root = shared_root(spark)
    ev = in_turns(log_events(spark, d).select("event_id", "us", "severity", "score"), 3)
    listener = S.MetricsListener(spark, f"{root}/metrics")
    spark.streams.addListener(listener)
    try:
        seen = [F.count("*").alias("rows"), F.count_if(F.expr("severity = 4")).alias("errors"), F.avg("score").alias("mean_score"), F.min("us").alias("oldest"), F.max("us").alias("newest")]
        streamed_in_turns(spark, ev, lambda s: s.observe("stage", *seen), 3)
        listener.wait_for(3)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.parquet(f"{root}/metrics").filter("metric not like '%rate'").select("batch", "metric", F.round("value", 6).alias("value"))


@query("j9_replay", EV_SQL + "SELECT source, count(*) AS n FROM ev GROUP BY source")
def j9(spark, d):
    """The input twice, with deterministic ids, counts once."""
    from logloom.sources.ingest import deterministic_event_id

    ev = log_events(spark, d).select(deterministic_event_id(F.lit("events"), F.col("k"), F.col("event_id")).alias("uuid"), "source")
    return streamed(spark, ev.unionAll(ev), lambda s: s.select("uuid", "source")).dropDuplicates(["uuid"]).groupBy("source").agg(F.count("*").alias("n"))


@query("j10_late_rows", EV_SQL + "SELECT (us < (SELECT max(us) FROM ev) - 864000000000)::BOOLEAN AS late, count(*) AS n FROM ev GROUP BY 1")
def j10(spark, d):
    ev = log_events(spark, d)
    # as microseconds: a datetime of Python's would pass through the zone of the driver's machine
    last = F.timestamp_add("MICROSECOND", F.lit(ev.agg(F.max("us")).first()[0]).cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    good, late = S.split_late(ev, "ts", last, 864000)
    marked = late.select(F.when(F.col("us").isNotNull(), True).alias("late"))  # without a time it is not known
    return good.select(F.lit(False).alias("late")).union(marked).groupBy("late").agg(F.count("*").alias("n"))


@query("j11_enrich_stream", EV_SQL + "SELECT event_id, CASE WHEN user_id % 20 < 5 THEN 'gold' END AS tier FROM ev")
def j11(spark, d):
    root = shared_root(spark)
    ev = log_events(spark, d).select("event_id", "host")
    ev.write.parquet(f"{root}/in")
    lookup = log_events(spark, d).filter("user_id % 20 < 5").select("host", F.lit("gold").alias("tier")).distinct()
    lookup.write.parquet(f"{root}/lookup")
    stream = spark.readStream.schema(ev.schema).parquet(f"{root}/in")
    writer = S.enrich_stream(stream, lambda s: s.read.parquet(f"{root}/lookup"), ["host"], lambda b, i: b.write.mode("overwrite").parquet(f"{root}/out/batch={i}"))
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "tier")


@query("j12_chained", SCORED_SQL + "SELECT event_id, action FROM scored WHERE action <> 'discard'")
def j12(spark, d):
    root = shared_root(spark)
    ev = log_events(spark, d).select("event_id", "score")
    ev.write.parquet(f"{root}/in")
    route = lambda s: s.withColumn("action", F.when(F.col("score") >= 0.95, "escalate").when(F.col("score") >= 0.39, "monitor").otherwise("discard"))
    path = S.chained([route, lambda s: s.filter("action <> 'discard'").select("event_id", "action")], spark, ev.schema, f"{root}/in", root)
    return spark.read.parquet(path)


@query("j13_pipeline_metrics", EV_SQL + "SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM ev UNION ALL SELECT 'errors', count(*) FILTER (WHERE severity = 4)::DOUBLE FROM ev")
def j13(spark, d):
    return S.pipeline_metrics(log_events(spark, d), {"rows": F.count("*"), "errors": F.count_if(F.expr("severity = 4"))})


def labelled(spark, d):
    return log_events(spark, d).withColumns({"label": (F.col("value") + F.col("k") > 100).cast("int"), "attack_type": F.col("event_type"), "dataset": F.col("source")})


@query("m1_training_frame", EV_SQL + "SELECT source, CASE WHEN value + k > 100 THEN 1 ELSE 0 END AS label, CASE WHEN k % 4 = 0 THEN CASE WHEN value + k > 100 THEN 'unknown' ELSE 'normal' END ELSE event_type END AS attack_type, count(*) AS n FROM ev GROUP BY ALL")
def m1(spark, d):
    rows = labelled(spark, d).select("source", "value", F.when(F.col("label") == 1, 3).otherwise(-1).alias("label"), F.when(F.col("k") % 4 == 0, " ").otherwise(F.col("attack_type")).alias("attack_type"), "k")
    out = M.build_training_frame([rows.filter("k < 50"), rows.filter("k >= 50")], ["value"])
    return out.groupBy("source", "label", "attack_type").agg(F.count("*").alias("n"))


@query("m2_balanced_sample", EV_SQL + "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY source, event_type ORDER BY md5(event_id || ':42'), event_id) AS r FROM ev) WHERE r <= 100")
def m2(spark, d):
    return M.balanced_sample(log_events(spark, d), ["source", "event_type"], 100, "event_id").select("event_id")


@query("m3_stratified_sample", EV_SQL + ", r AS (SELECT event_type, least(1.0, 300 / count(*)) AS rate FROM ev GROUP BY event_type) SELECT event_id FROM ev JOIN r USING (event_type) WHERE ('0x' || substr(md5(event_id || ':42'), 1, 8))::BIGINT / 4294967296 < rate")
def m3(spark, d):
    return M.stratified_sample(log_events(spark, d), "event_type", 300, "event_id").select("event_id")


@query("m4_reservoir_sample", EV_SQL + "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY host ORDER BY md5(event_id || ':42'), event_id) AS r FROM ev) WHERE r <= 10")
def m4(spark, d):
    return M.balanced_sample(log_events(spark, d), ["host"], 10, "event_id").select("event_id")


@query("m5_capped_sample", EV_SQL + ", c AS (SELECT *, CASE WHEN severity = 4 THEN 0 WHEN k % 5 = 0 THEN 1 ELSE 2 END AS r, CASE WHEN severity = 4 THEN 'severe' WHEN k % 5 = 0 THEN 'fifth' ELSE 'other' END AS category FROM ev), h AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY r, md5(event_id || ':42'), event_id) AS n FROM c) SELECT event_id, category FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY r, md5(event_id || ':42'), event_id) AS m FROM h WHERE n <= 50) WHERE m <= 5")
def m5(spark, d):
    categories = [("severe", F.col("severity") == 4), ("fifth", F.col("k") % 5 == 0)]
    return M.capped_sample(log_events(spark, d), categories, {"host": 50, "usr": 5}, "event_id").select("event_id", "category")


NUMBERS = ["value", "k", "duration_ms"]


@query("m6_train_classifier")
def m6(spark, d):
    rows = labelled(spark, d)
    return M.score_classifier(M.train_classifier(rows, NUMBERS), rows).select("event_id", "label", "model_score")


@query("m6_stratified_folds", EV_SQL + """, r AS (SELECT event_id, CASE WHEN value + k > 100 THEN 1 ELSE 0 END AS label, (row_number() OVER (PARTITION BY CASE WHEN value + k > 100 THEN 1 ELSE 0 END ORDER BY md5(event_id || ':42'), event_id) - 1) % 5 AS fold FROM ev)
SELECT fold::INT AS fold, label, count(*) AS n, min(event_id) AS first, sum(event_id)::BIGINT AS ids FROM r GROUP BY fold, label""")
def m6_folds(spark, d):
    rows = M.stratified_folds(labelled(spark, d), "label", "event_id")
    return rows.groupBy("fold", "label").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.sum("event_id").alias("ids"))


@query("m6_cross_validated")
def m6_cross_validated(spark, d):
    """Every row's score by the trees that have not seen its fold."""
    rows = M.stratified_folds(labelled(spark, d).select("event_id", "source", "label", *NUMBERS), "label", "event_id")
    return M.cross_validated(rows, NUMBERS, rounds=5, depth=4, rate=0.3)[1].select("event_id", "source", "label", "fold", "model_score")


@query("m7_masked_anomaly")
def m7_masked(spark, d):
    """Learned on normal rows; the column that hangs on the stream's state does not count."""
    rows = labelled(spark, d)
    normal = rows.filter("label = 0")
    model = M.train_anomaly(normal, [*NUMBERS, "bytes_in"], masked=["bytes_in"])
    return M.score_anomaly(model, rows, "source", normal).select("event_id", "source", "error", "anomaly")


@query("m7_train_anomaly")
def m7(spark, d):
    rows = labelled(spark, d)
    return M.score_anomaly(M.train_anomaly(rows, NUMBERS), rows, "source").select("event_id", "source", "error", "anomaly")


FEATURES = ["score", "score2", "score3"]


def linear():
    return 0.5 * F.col("score") + 0.3 * F.col("score2") + 0.2 * F.col("score3")


ATTR_SQL = ", a AS (SELECT event_id, unnest([{'f': 'score', 'v': 0.5 * score}, {'f': 'score2', 'v': 0.3 * score2}, {'f': 'score3', 'v': 0.2 * score3}]) AS x FROM ev)\n"


@query("m8_feature_attribution", EV_SQL + ATTR_SQL + "SELECT event_id, x.f AS feature, round(x.v, 6) AS value FROM a")
def m8(spark, d):
    return M.feature_attribution(log_events(spark, d), linear(), FEATURES, "event_id").select("event_id", "feature", "value")


@query("m9_category_attribution", EV_SQL + ATTR_SQL + "SELECT CASE WHEN x.f = 'score' THEN 'rule' ELSE 'model' END AS category, round(sum(abs(x.v)), 6) AS contribution, count(*) AS n FROM a GROUP BY 1")
def m9(spark, d):
    rows = M.feature_attribution(log_events(spark, d), linear(), FEATURES, "event_id")
    return M.category_attribution(rows, {"score": "rule", "score2": "model", "score3": "model"})


@query("m10_assign_label", EV_SQL + "SELECT event_id, CASE WHEN score2 >= 0.85 AND 1 - abs(score2 - score3) >= 0.7 THEN 1 WHEN score2 <= 0.15 AND 1 - abs(score2 - score3) >= 0.7 THEN 0 END AS label FROM ev")
def m10(spark, d):
    return log_events(spark, d).select("event_id", M.assign_label(F.col("score2"), 1 - F.abs(F.col("score2") - F.col("score3"))).alias("label"))


@query("m10_augment", EV_SQL + ", c AS (SELECT event_id, value, unnest([1, 2]) AS copy FROM ev) SELECT event_id, copy, round(value * (1 + 0.05 * (2 * (('0x' || substr(md5(event_id || ':' || copy || ':value'), 1, 8))::BIGINT / 4294967296) - 1)), 6) AS value FROM c")
def m10b(spark, d):
    return M.augment(log_events(spark, d).select("event_id", "value"), ["value"], 2, "event_id")


def vectors_of(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


NEAR_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, list_distance(q.e, c.e) AS distance FROM v q JOIN v c ON {on} WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p)
"""


@query("n1_embed")
def n1(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = V.embed(log_events(spark, d).select("event_id", "message"), "message")
    return rows.select("event_id", F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda s, x: s + x * x).alias("length"))


@query("n2_vector_search", NEAR_SQL.format(on="true") + "SELECT query_id, id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 10")
def n2(spark, d):
    corpus = vectors_of(spark, d)
    queries = corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return V.vector_search(queries, corpus, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "distance")


@query("n3_find_similar", NEAR_SQL.format(on="c.vec_id <> q.vec_id") + "SELECT query_id, id, round(distance, 6) AS distance FROM r WHERE rank <= 5")
def n3(spark, d):
    return V.find_similar(vectors_of(spark, d), F.col("id") % 20 == 0, 5).select("query_id", "id", "distance")


@query("h9_similarity_features", NEAR_SQL.format(on="c.vec_id <> q.vec_id") + "SELECT query_id, round(min(distance), 6) AS nearest, count(*) FILTER (WHERE distance < 0.3) AS within_3, count(*) FILTER (WHERE distance < 0.4) AS within_4, count(*) FILTER (WHERE distance < 0.5) AS within_5, round(coalesce(avg((label = 1)::INT) FILTER (WHERE distance < 0.5), 0), 6)::DOUBLE AS label_confidence FROM r WHERE rank <= 20 GROUP BY query_id")
def h9(spark, d):
    return H.similarity_features(V.find_similar(vectors_of(spark, d), F.col("id") % 20 == 0, 20))


@query("n4_confirmed_corpus", SCORED_SQL + "SELECT event_id, CASE WHEN score >= 0.95 THEN 4 ELSE 3 END AS severity, 'score' AS origin FROM scored WHERE action = 'escalate' AND score > 0.8 UNION ALL SELECT event_id, CASE WHEN k % 3 = 0 THEN 4 WHEN k % 3 = 1 THEN 3 ELSE 2 END, 'verdict' FROM scored WHERE severity = 4")
def n4(spark, d):
    ev = scored(spark, d)
    priority = F.element_at(F.array(*map(F.lit, ("P1", "P2", "P3"))), F.col("k") % 3 + 1)
    return V.confirmed_attack_corpus(ev, ev.select("event_id", F.when(F.col("severity") == 4, "true_positive").otherwise("inconclusive").alias("verdict"), priority.alias("priority")))


@query("n5_incident_corpus")
def n5(spark, d):
    rows = log_events(spark, d).filter("severity >= 3").select(F.col("event_id").alias("id"), "message", F.lit("incident").alias("kind"))
    return V.incident_corpus(rows, "message").select("id", "text", "kind")
