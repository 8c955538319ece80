"""Streams in several micro-batches: exact windows, late and repeated rows, metrics, carried state."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import windows
from logloom.plans import stream_plans as P
from logloom.streaming import trailing


def test_trailing_measures_by_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(20):
        n = 60
        at = np.sort(draw.integers(0, 400, n))
        text = np.array([None if x == 3 else f"t{x}" for x in draw.integers(0, 4, n)], object)
        number = draw.random(n)
        for kind, values in (("count", None), ("same", text), ("distinct", text), ("sum", number)):
            got = trailing.trailing_values(at, values, kind, 50)
            for i in range(n):
                held = [j for j in range(n) if at[i] - 50 <= at[j] <= at[i]]
                want = {"count": len(held), "same": sum(text[j] == text[i] and text[i] is not None for j in held), "distinct": len({text[j] for j in held} - {None}), "sum": sum(number[j] for j in held)}[kind]
                assert abs(got[i] - want) < 1e-9, kind


def test_trailing_stream_is_the_batch_window(spark):
    """Connections of the last two seconds, as the batch operator counts them, from rows out of order in five micro-batches."""
    draw = random.Random(4)
    rows, at = [], 1_700_000_000_000_000
    for i in range(400):
        at += draw.choice((0, 200_000, 900_000, 2_000_000, 30_000_000))
        rows.append((i, at, f"s{draw.randrange(2)}", f"d{draw.randrange(2)}", draw.choice((22, 80)), draw.choice(("syn flood", "reset by peer rst", "ok", None)), 10, 10, 5))
    rows.append((900, at + 3_600_000_000, "end", "end", 1, None, 1, 1, 1))  # moves the watermark past the others
    df = spark.createDataFrame(rows, "event_id long, us long, src_ip string, dst_ip string, dst_port int, message string, bytes_in int, bytes_out int, duration_ms int")
    late = F.pmod(F.xxhash64("event_id"), F.lit(60)) * 1_000_000
    ev = P.in_turns(df.withColumns({"at": F.timestamp_micros("us"), "service": F.col("dst_port").cast("string")}), 5, F.when(F.col("event_id") < 900, late).otherwise(0))
    measures = [trailing.Trailing("conn_count", "count", 2), trailing.Trailing("same_service", "same", 2, "service")]
    got = {r.event_id: (r.conn_count, r.same_service) for r in P.streamed_in_turns(spark, ev, lambda s: trailing.trailing_stream(s, ["src_ip", "dst_ip"], measures, slot_s=30.0, late="5 minutes"), 5).collect()}
    want = {r.event_id: (r.conn_count, r.same_service) for r in windows.connection_features_time(df).collect() if r.event_id < 900}
    assert got == want
    assert max(n for n, _ in want.values()) > 2


def test_state_leaves_with_the_watermark(spark):
    """Slots that no window reaches are removed: the state's size goes with the span, not with the stream."""
    rows = [(i, (i + 1_000_000) * 1_000_000, "k") for i in range(4_000)]  # Spark's first watermark is 1970
    df = P.in_turns(spark.createDataFrame(rows, "event_id long, us long, k string").withColumn("at", F.timestamp_micros("us")), 4)

    class Spy(trailing.TrailingProcessor):
        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
            assert len(list(self.slots.keys())) * 100 <= 300 + 1_000 + 600

    plain, trailing.TrailingProcessor = trailing.TrailingProcessor, Spy
    try:
        out = P.streamed_in_turns(spark, df, lambda s: trailing.trailing_stream(s, ["k"], [trailing.Trailing("n", "count", 300)], slot_s=100.0, late="300 seconds"), 4)
        got = {r.event_id: r.n for r in out.collect()}
    finally:
        trailing.TrailingProcessor = plain
    assert (max(got), len(got)) == (3_599, 3_600)
    assert got == {i: min(i + 1, 301) for i in range(3_600)}


def test_late_rows_are_those_that_spark_drops(spark, tmp_path):
    """The side table holds as many rows as Spark's own watermark would drop, and a repeated micro-batch changes nothing."""
    from logloom.streaming import streams

    rows = [(i, (i + 10_000 if i % 9 else i + 9_500) * 10_000_000) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, us long").withColumns({"at": F.timestamp_micros("us"), "turn": (F.col("event_id") / 200).cast("int")})
    root, dropped = f"file://{tmp_path}", 0
    for i in range(3):
        part = df.filter(F.col("turn") == i).drop("turn")
        part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        streams.route_late(source, "us", root).option("checkpointLocation", f"{root}/c1").trigger(availableNow=True).start().awaitTermination()
        counted = source.withWatermark("at", "600 seconds").dropDuplicatesWithinWatermark(["event_id"]).writeStream.format("parquet").option("path", f"{root}/kept").option("checkpointLocation", f"{root}/c2").trigger(availableNow=True).start()
        counted.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in counted.recentProgress for s in p["stateOperators"])
        # the same micro-batch again, as after a lost driver
        before = streams.routed(spark, root).groupBy("batch", "late").count().collect()
        mark = streams.watermark_before(spark, root, i, 600_000_000)
        late = F.lit(False) if mark is None else F.col("us") <= mark
        assert {(r.late, r["count"]) for r in before if r.batch == i} == {(bool(r.late), r["count"]) for r in part.withColumn("late", late).groupBy("late").count().collect()}
    side = streams.routed(spark, root)
    assert side.count() == len(rows)
    assert side.filter("late").count() == dropped > 20


def test_late_rows_to_the_microsecond(spark, tmp_path):
    """Rows at the limit, a microsecond and under a second beyond it, and without a time, as the query's SQL counts them."""
    newest = 1_705_000_000_250_000
    behind = [0, 864_000_000_000, 864_000_000_001, 864_000_750_000, 864_001_000_000, None]
    rows = [(i, None if b is None else newest - b) for i, b in enumerate(behind)]
    frame = spark.createDataFrame(rows, "event_id long, us long").select("event_id", F.timestamp_add("MICROSECOND", "us", F.lit("1970-01-01").cast("timestamp_ntz")).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"))
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = set(con.execute(P.ORACLE_SQL["j10_late_rows"]).fetchall())
    assert {tuple(r) for r in P.j10(spark, str(tmp_path)).select("late", "n").collect()} == want == {(False, 2), (True, 3), (None, 1)}
