"""Streaming and stateful operators (inventory J).

The stateful ones hold a key's state in the state store, where an idle key's can expire. Each gives the rows
that its batch twin in ``operators.windows`` gives on the same input in time order.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from logloom.operators.joins import small
from logloom.sources.ingest import append_sink


def tumbling_counts(df: DataFrame, ts: str, keys: list[str], length: str, late: str = "10 minutes") -> DataFrame:
    """Counts in windows of fixed length, with a watermark."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("events"))


def hopping_counts(df: DataFrame, ts: str, keys: list[str], length: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Counts in overlapping windows."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, length, step), *keys).agg(F.count("*").alias("events"))


def idle_sessions(df: DataFrame, ts: str, keys: list[str], gap: str = "3600 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions that end when a key is idle for long enough."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("events"))


def suppress_duplicates(df: DataFrame, ts: str, keys: list[str], within: str = "300 seconds") -> DataFrame:
    """The first row of a key, and no other within the span."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def split_late(df: DataFrame, ts: str, as_of: Column, late_seconds: int = 600) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and those later than the watermark would allow, for a side table (J10); rows without a time go there too.

    Lateness is told to the microsecond: a difference in seconds drops the part of a second by which a row is late.
    """
    is_late = F.coalesce(F.timestamp_diff("MICROSECOND", F.col(ts), as_of) > late_seconds * 1_000_000, F.lit(True))
    return df.filter(~is_late), df.filter(is_late)


def watermark_before(spark: SparkSession, root: str, batch_id: int, late_us: int) -> int | None:
    """The watermark that earlier micro-batches have set, as Spark reckons it: their newest row, in whole milliseconds, less the
    lateness; None before the first."""
    try:
        marks = spark.read.schema("newest long, batch long").parquet(f"{root}/marks")
    except AnalysisException:  # nothing was written yet
        return None
    newest = marks.filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
    return None if newest is None else newest // 1_000 * 1_000 - late_us


def route_late(df: DataFrame, us: str, root: str, late_seconds: int = 600) -> DataStreamWriter:
    """A writer of rows in time and of late ones to ``root``/rows, apart by ``late``, each once.

    A row is late if it is no newer than the watermark, which is kept in a table by micro-batch: so a repeated micro-batch
    decides as it did the first time, and overwrites what it wrote. Rows without a time are late. Rows are read once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = watermark_before(spark, root, batch_id, late_seconds * 1_000_000)
        late = F.col(us).isNull() if mark is None else F.coalesce(F.col(us) <= mark, F.lit(True))
        seen = Observation()
        batch.withColumn("late", late).observe(seen, F.max(us).alias("newest")).write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/batch={batch_id}")
        spark.createDataFrame([(seen.get["newest"],)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")

    return df.writeStream.foreachBatch(step)


def routed(spark: SparkSession, root: str) -> DataFrame:
    """The rows that ``route_late`` has written, with ``late`` and ``batch``."""
    rows = spark.read.parquet(f"{root}/rows")
    return rows.withColumns({"late": F.col("late").cast("boolean"), "batch": F.col("batch").cast("long")})


class MetricsListener(StreamingQueryListener):
    """Appends what streams report of each micro-batch to a long table (query, batch, at, metric, value).

    Rates come from Spark's progress reports, all else from ``observed`` columns: ``oldest`` and ``newest`` times give the
    lag, how far a micro-batch's oldest row is behind the newest so far; columns ``mean_*`` give the drift, their
    distance from ``baseline``, or from the first micro-batch. Rows are written when some have come and when a query ends.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 200, baseline: dict[str, float] | None = None):
        self.spark, self.path, self.every = spark, path, every
        self.baseline, self.newest = dict(baseline or {}), {}
        self.rows: list[tuple] = []
        self.ended: set[str] = set()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        values = {"input_rate": p.inputRowsPerSecond, "processed_rate": p.processedRowsPerSecond}
        for name, row in p.observedMetrics.items():
            seen = {k: v for k, v in row.asDict().items() if v is not None}
            if "newest" in seen and "oldest" in seen:
                self.newest[name] = max(seen.pop("newest"), self.newest.get(name, -(1 << 62)))
                values["lag_s"] = (self.newest[name] - seen.pop("oldest")) / 1e6
            for k, v in seen.items():
                values[k] = float(v)
                if k.startswith("mean_"):
                    values[f"drift_{k[5:]}"] = abs(v - self.baseline.setdefault(k, v))
        with self.lock:
            self.rows += [(str(p.name or p.id), int(p.batchId), str(p.timestamp), k, float(v)) for k, v in values.items()]
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, "query string, batch long, at string, metric string, value double").coalesce(1).write.mode("append").parquet(self.path)

    def wait_for(self, runs: int, seconds: float = 60.0) -> None:
        """Until so many runs have been reported as ended; reports come after the query itself."""
        until = time.monotonic() + seconds
        while len(self.ended) < runs and time.monotonic() < until:
            time.sleep(0.05)
        self.flush()


class KeyedState(StatefulProcessor):
    """One value of state for each key. With ``ttl_ms`` an idle key's state leaves after that processing time."""

    fields: tuple[tuple[str, object], ...] = ()

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField(name, kind) for name, kind in self.fields])
        self.state = handle.getValueState("state", schema) if self.ttl_ms is None else handle.getValueState("state", schema, self.ttl_ms)

    def close(self) -> None:
        pass


class EwmaProcessor(KeyedState):
    """Decayed rates of each key (J4): state is the rates and the time of the last row.

    Rows of a batch are taken in time order.
    """

    fields = (("fast", DoubleType()), ("medium", DoubleType()), ("slow", DoubleType()), ("error", DoubleType()), ("us", LongType()))

    def __init__(self, half_lives: tuple[float, float, float], ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.half_lives = half_lives

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        rates, last = (list(held[:4]), held[4]) if held else ([0.0] * 4, None)
        out = []
        for us, severity, event in zip(batch["us"], batch["severity"], batch["event_id"], strict=True):
            gap = 0.001 if last is None else max((us - last) / 1e6, 0.001)
            halves = (*self.half_lives, self.half_lives[1])
            rates = [r * 0.5 ** (gap / h) + x for r, h, x in zip(rates, halves, (1, 1, 1, int(severity >= 4)), strict=True)]
            last = int(us)
            out.append((event, *rates))
        self.state.update((*map(float, rates), last))
        yield pd.DataFrame(out, columns=["event_id", "rate_fast", "rate_medium", "rate_slow", "error_rate"])


def with_state(df: DataFrame) -> DataFrame:
    """``df``, its session set to the state store that the state API needs."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


def ewma_stream(df: DataFrame, key: str, half_lives: tuple[float, float, float] = (2.0, 60.0, 600.0), ttl_ms: int | None = None) -> DataFrame:
    return with_state(df).groupBy(key).transformWithStateInPandas(EwmaProcessor(half_lives, ttl_ms), "event_id long, rate_fast double, rate_medium double, rate_slow double, error_rate double", "append", "none" if ttl_ms is None else "processingTime")


class BaselineProcessor(KeyedState):
    """Running mean and deviation of each key and the z of every row."""

    fields = (("n", LongType()), ("mean", DoubleType()), ("m2", DoubleType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        out = []
        for x, event in zip(batch["score"], batch["event_id"], strict=True):
            n += 1
            delta = x - mean
            mean += delta / n
            m2 += delta * (x - mean)
            std = (m2 / n) ** 0.5
            out.append((event, 0.0 if n < 10 or std < 1e-6 else (x - mean) / std))
        self.state.update((int(n), float(mean), float(m2)))
        yield pd.DataFrame(out, columns=["event_id", "z"])


def baseline_stream(df: DataFrame, key: str, ttl_ms: int | None = None) -> DataFrame:
    return with_state(df).groupBy(key).transformWithStateInPandas(BaselineProcessor(ttl_ms), "event_id long, z double", "append", "none" if ttl_ms is None else "processingTime")


class KillChainProcessor(KeyedState):
    """Attack stage of each key (J5), the streaming form of the batch fold."""

    fields = (("stage", LongType()), ("last", LongType()))

    def __init__(self, gate: float, idle_s: float, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.gate, self.idle_s = gate, idle_s

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        stage, last = self.state.get() if self.state.exists() else (0, None)
        out = []
        for us, step, score, event in zip(batch["us"], batch["step"], batch["score"], batch["event_id"], strict=True):
            last = int(us) if last is None else last
            if us - last > self.idle_s * 1e6:
                stage = 0
            if score > self.gate:
                stage, last = max(stage, int(step)), int(us)
            out.append((event, stage))
        self.state.update((int(stage), int(last)))
        yield pd.DataFrame(out, columns=["event_id", "chain_stage"])


def kill_chain_stream(df: DataFrame, key: str, gate: float = 0.3, idle_s: float = 3600.0, ttl_ms: int | None = None) -> DataFrame:
    return with_state(df).groupBy(key).transformWithStateInPandas(KillChainProcessor(gate, idle_s, ttl_ms), "event_id long, chain_stage int", "append", "none" if ttl_ms is None else "processingTime")


def enrich_stream(df: DataFrame, read_lookup, on: list[str], write) -> object:
    """A writer that joins each micro-batch with a lookup read anew for it."""

    def step(batch: DataFrame, batch_id: int) -> None:
        write(batch.join(small(read_lookup(batch.sparkSession)), on, "left"), batch_id)

    return df.writeStream.foreachBatch(step)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is now into a Parquet table."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_every(df: DataFrame, path: str, checkpoint: str, every: str = "500 milliseconds", mode: str = "append") -> StreamingQuery:
    """Run a stream into a Parquet table, a micro-batch at each interval, until it is stopped.

    Rows of a micro-batch are bounded by its source, as with ``maxOffsetsPerTrigger`` or ``maxFilesPerTrigger``.
    """
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_fan_out(df: DataFrame, root: str, checkpoint: str) -> None:
    """Classified records to one folder for each family and day, each micro-batch written once."""
    df.writeStream.foreachBatch(lambda batch, i: append_sink(batch, i, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def chained(stages: list, spark: SparkSession, schema: StructType, source: str, root: str) -> str:
    """Stages one after the other, each a stream from the table before to a table of its own (J12). The last table."""
    path = source
    for i, stage in enumerate(stages):
        out = f"{root}/stage-{i}"
        run_available(stage(spark.readStream.schema(schema).parquet(path)), out, f"{root}/checkpoint-{i}")
        schema, path = spark.read.parquet(out).schema, out
    return path


def pipeline_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Metrics as long (metric, value) rows."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("m")).select("m.*")
