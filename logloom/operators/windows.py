"""Window functions and keyed sequential features (inventory F, G5, G10, H1)."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logloom.functions.scalar import connection_error_type
from logloom.operators.folds import SEGMENT_ROWS, EwmaFold, GateFold, KillChainFold, fold_by_segments, time_segments
from logloom.operators.rollups import time_bucket
from logloom.operators.sweeps import appearances, running_totals


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each key (F1, F3). ``row_number() = 1`` is cut down within tasks before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie)))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def latest_per_metric(df: DataFrame, metric: str, ts: str, value: str) -> DataFrame:
    """The newest value of each metric, by partial aggregation (F2)."""
    return df.groupBy(metric).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def connection_features_time(df: DataFrame, us: str = "us", seconds: float = 2.0) -> DataFrame:
    """Over the trailing seconds of each (src_ip, dst_ip), the row included: connections, those to the same port, and
    the shares of same and other ones, of SYN errors and of rejections, told by text, bytes and duration (F4)."""
    span = int(seconds * 1_000_000)
    pair = Window.partitionBy("src_ip", "dst_ip").orderBy(us).rangeBetween(-span, 0)
    same = Window.partitionBy("src_ip", "dst_ip", "dst_port").orderBy(us).rangeBetween(-span, 0)
    n = F.count("*").over(pair)
    error = connection_error_type(F.col("message"), F.col("bytes_in") + F.col("bytes_out"), F.col("duration_ms"))
    out = df.withColumns({"conn_count": n, "same_service": F.count("*").over(same), **{f"_{kind}": F.sum((error == kind).cast("int")).over(pair) for kind in ("syn_error", "reject_error")}})
    return out.withColumns({"same_service_rate": F.col("same_service") / F.col("conn_count"), "diff_service_rate": 1 - F.col("same_service") / F.col("conn_count"), "serror_rate": F.col("_syn_error") / F.col("conn_count"), "rerror_rate": F.col("_reject_error") / F.col("conn_count")}).drop("_syn_error", "_reject_error")


def connection_features_host(df: DataFrame, order: list[str], rows: int = 100) -> DataFrame:
    """Over the last connections of each destination, this one included: distinct sources and those to its port."""
    last = Window.partitionBy("dst_ip").orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({"host_sources": F.size(F.array_distinct(F.collect_list("src_ip").over(last))), "host_same_service": F.size(F.filter(F.collect_list("dst_port").over(last), lambda p: p == F.col("dst_port")))})


def connection_rates(df: DataFrame, key: str, us: str = "us", fast_s: float = 2, slow_s: float = 600) -> DataFrame:
    """Connections of each source in a short and a long trailing span and their acceleration, 100 at most."""
    span = lambda s: Window.partitionBy(key).orderBy(us).rangeBetween(-int(s * 1_000_000), 0)
    out = df.withColumns({"fast": F.count("*").over(span(fast_s)), "slow": F.count("*").over(span(slow_s))})
    return out.withColumn("acceleration", F.least(F.col("fast") / F.greatest(F.col("slow") / (slow_s / fast_s), F.lit(0.01)), F.lit(100.0)))


def port_entropy(df: DataFrame, key: str, order: list[str], rows: int = 200) -> DataFrame:
    """Entropy in bits of the last destination ports of each source (F7); ports that are null do not count.

    Ports are counted as the rows of a source pass in order: a row moves two counts, however many rows are looked back on.
    All columns of ``df`` pass through Python, so few are best.
    """
    # n log2 n in whole units, so that sums do not drift
    unit = 1 << 40
    part = [0, *(round(n * math.log2(n) * unit) for n in range(1, rows + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts, total = None, deque(), {}, 0
        begun = False
        for batch in batches:
            at = batch.schema.get_field_index
            bits = []
            for source, port in zip(batch.column(at(key)).to_pylist(), batch.column(at("dst_port")).to_pylist(), strict=True):
                if source != now or not begun:
                    now, begun = source, True
                    held.clear()
                    counts.clear()
                    total = n = 0
                if len(held) == rows and (old := held.popleft()) is not None:
                    c = counts[old]
                    total += part[c - 1] - part[c]
                    n -= 1
                    if c == 1:
                        del counts[old]
                    else:
                        counts[old] = c - 1
                held.append(port)
                if port is not None:
                    c = counts.get(port, 0)
                    total += part[c + 1] - part[c]
                    n += 1
                    counts[port] = c + 1
                bits.append(math.log2(n) - total / (unit * n) if len(counts) > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.float64())], names=[*batch.schema.names, "port_entropy"])

    schema = StructType([*df.schema.fields, StructField("port_entropy", DoubleType())])
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def source_novelty(df: DataFrame, keys: list[str], us: str = "us", hours: int = 24) -> DataFrame:
    """1 where a source is new to its host or was last seen longer ago (F8)."""
    before = F.lag(us).over(Window.partitionBy(*keys).orderBy(us, "event_id"))
    return df.withColumn("novelty", F.coalesce((F.col(us) - before > hours * 3_600_000_000).cast("int"), F.lit(1)))


def running_baseline_z(df: DataFrame, key: str, order: list[str], score: str = "score", least: int = 10, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """z of each score against all scores of its key so far, its own included; 0 for fewer than ten.

    Number, mean and sum of squares run within segments of time (``order`` starts with a number, the time), and those of
    the segments before are merged in: a hot key is spread over its segments. Null scores do not count.
    """
    cut = time_segments(df, order[0], segment_rows)
    so_far = Window.partitionBy(key, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, "_segment").agg(F.count(score).alias("_n"), F.sum(score).alias("_sum"), F.coalesce(F.var_pop(score), F.lit(0.0)).alias("_var"))
    sums = sums.withColumn("_mean", F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0)))
    # a key's segments, a row each: merged in order
    rows = F.collect_list(F.struct("_n", "_mean", (F.col("_var") * F.col("_n")).alias("m2"))).over(earlier)
    merged = sums.select(F.col(key).alias("_key"), F.col("_segment").alias("_at"), F.aggregate(rows, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), lambda a, x: _merged(a["n"], a["mean"], a["m2"], x["_n"], x["_mean"], x["m2"])).alias("_before"))
    own = cut.withColumns({"_n": F.count(score).over(so_far), "_mean": F.coalesce(F.avg(score).over(so_far), F.lit(0.0)), "_var": F.coalesce(F.var_pop(score).over(so_far), F.lit(0.0))})
    met = own.join(merged, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_segment") == F.col("_at")))
    met = met.withColumn("_all", _merged(F.col("_before.n"), F.col("_before.mean"), F.col("_before.m2"), F.col("_n"), F.col("_mean"), F.col("_var") * F.col("_n")))
    std = F.sqrt(F.try_divide(F.col("_all.m2"), F.col("_all.n")))
    z = F.when((F.col("_all.n") < least) | (std < 1e-6), 0.0).otherwise((F.col(score) - F.col("_all.mean")) / std)
    return met.select(*df.columns, z.alias("baseline_z"))


def _merged(n: Column, mean: Column, m2: Column, more: Column, more_mean: Column, more_m2: Column) -> Column:
    """Number, mean and sum of squared deviations of two sets together."""
    total = n + more
    share = F.coalesce(F.try_divide(more.cast("double"), total), F.lit(0.0))
    gap = more_mean - mean
    return F.struct(total.alias("n"), (mean + gap * share).alias("mean"), (m2 + more_m2 + gap * gap * n * share).alias("m2"))


def cross_host_count(df: DataFrame, us: str = "us", seconds: int = 900, least: float = 0.5, row: str = "event_id") -> DataFrame:
    """Distinct hosts with a high score in the trailing span of each high-scored row, 0 for the others (F12). ``row`` tells rows apart.

    The span has no key: hosts that appear and pass are totalled over slots of time, so no rows are paired and no task
    holds more than a slot.
    """
    span = seconds * 1_000_000
    high = df.filter(F.col("score") >= least).withColumn("_all", F.lit(0))
    counts = running_totals(high, "_all", us, [appearances(high, "_all", "host", us, span, "cross_hosts")], span, row)
    return df.join(counts.select(row, "cross_hosts"), row, "left").withColumn("cross_hosts", F.coalesce("cross_hosts", F.lit(0)))


def chain_check(anchors: DataFrame) -> DataFrame:
    """Whether each anchor's previous root is the root of the anchor before it, by table."""
    before = F.lag("merkle_root").over(Window.partitionBy("table_name").orderBy("time_from"))
    return anchors.withColumn("chain_ok", F.coalesce(F.col("prev_root") == before, F.col("prev_root") == ""))


def coherent_timeline(df: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    """Rows out of time order in the order of arrival, and whether they are few: one, or a twentieth."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(order))
    flagged = df.withColumn("_late", (F.col(ts) < before).cast("int"))
    counts = flagged.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("_late"), F.lit(0)).alias("late"))
    return counts.withColumn("coherent", F.col("late") <= F.greatest(F.lit(1.0), F.col("n") * 0.05))


def bursts(df: DataFrame, keys: list[str], us: str = "us", seconds: int = 300, least: int = 50) -> DataFrame:
    """Buckets of a key with many rows."""
    return df.groupBy(*keys, F.floor(F.col(us) / (seconds * 1_000_000)).alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def sustained_alerts(metrics: DataFrame, key: str, at: str, breach: Column, for_at_least: int) -> DataFrame:
    """Spans in which a condition held without a break for long enough (F16): gaps and islands."""
    order = Window.partitionBy(key).orderBy(at)
    marked = metrics.withColumn("_on", F.coalesce(breach, F.lit(False)).cast("int"))
    islands = marked.withColumn("_island", F.sum((F.coalesce(F.lag("_on").over(order), F.lit(-1)) != F.col("_on")).cast("int")).over(order)).filter("_on = 1")
    spans = islands.groupBy(key, "_island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("points"))
    return spans.filter(F.col("end") - F.col("start") >= for_at_least).drop("_island")


def psi_trend(df: DataFrame, feature: str, psi: str) -> DataFrame:
    """Features by their greatest PSI."""
    most = df.groupBy(feature).agg(F.max(psi).alias("psi"), F.count("*").alias("points"))
    return most.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("psi"))))


def merge_windows(df: DataFrame, key: str, start: str, end: str, block: int = 3_600_000_000) -> DataFrame:
    """The union of overlapping windows of each key (G10), first of those that start in one time block."""

    def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(start, end)
        reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        grouped = rows.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return grouped.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("merged").alias("merged")).drop("_group")

    rows = df.withColumns({"merged": F.lit(1).cast("long"), "_block": F.floor(F.col(start) / block)})
    return merge(merge(rows, [key, "_block"]).drop("_block"), [key])


def ewma_rates(df: DataFrame, key: str, us: str = "us", order: str = "event_id", half_lives: tuple[float, float, float] = (2.0, 60.0, 600.0), window_s: float = 300.0, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Exponentially decayed event and error rates of each key, and distinct actions in a restarting window.

    A recurrence over a key's rows in time order. Adds rate_fast, rate_medium, rate_slow, error_rate (of the medium
    half-life), acceleration and unique_actions.
    """
    added = "rate_fast double, rate_medium double, rate_slow double, error_rate double, acceleration double, unique_actions int"
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + [added])
    return fold_by_segments(df, [key], us, order, EwmaFold(us, half_lives, window_s), schema, segment_rows)


def kill_chain(df: DataFrame, key: str, stage: str, us: str = "us", order: str = "event_id", gate: float = 0.3, idle_s: float = 3600.0, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Attack stage of each key so far: it only advances, on scores over the gate.

    When nothing has passed the gate for long enough, the stage starts anew. Adds chain_stage and chain_velocity, the
    inverse of the mean of the last five transition times (a second at least; 0 before two transitions).
    """
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + ["chain_stage int, chain_velocity double"])
    return fold_by_segments(df, [key], us, order, KillChainFold(us, stage, gate, idle_s), schema, segment_rows)


def alert_gate(df: DataFrame, keys: list[str], us: str = "us", order: str = "event_id", least: float = 0.8, quiet_s: float = 300.0, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """High scores, each key's alerts at least so many seconds apart, counted from the last one kept (H1)."""
    return fold_by_segments(df.filter(F.col("score") >= least), keys, us, order, GateFold(us, quiet_s), df.schema, segment_rows)


def daily_counts(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(key, time_bucket(F.col(ts), 86400).alias("day")).agg(F.count("*").alias("n"))
