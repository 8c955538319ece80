"""Sources, sinks and ingestion (inventory A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.operators.investigate import uuid_v5

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def read_topic(spark: SparkSession, name: str, schema: StructType, servers: str | None = None, path: str | None = None, rows_per_batch: int = 500_000) -> DataFrame:
    """A stream of JSON records of a topic, or of a folder of JSON files (A1, J8). Offsets are the checkpoint's."""
    if servers is not None:
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", rows_per_batch).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("record"), "topic", "partition", "offset").select("record.*", "topic", "partition", "offset")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(path)


def parse_records(df: DataFrame, payload: str, fields: dict[str, tuple[list[str], str, object]], keep: list[str] = ()) -> DataFrame:
    """Typed columns from JSON text (A2): of each field's aliases the first that is there; a missing field or a wrong
    type gives the default. The text is parsed once."""
    parsed = df.withColumn("_record", F.from_json(F.col(payload), "map<string,string>"))
    columns = [F.coalesce(F.coalesce(*[F.col("_record")[a] for a in aliases]).try_cast(kind), F.lit(default).cast(kind)).alias(name) for name, (aliases, kind, default) in fields.items()]
    return parsed.select(*keep, *columns)


def dead_letters(df: DataFrame, payload: str, topic: str) -> DataFrame:
    """The rows whose payload is not a JSON object, with stage, topic, error and payload cut to its limits (A3)."""
    bad = F.from_json(F.col(payload), "map<string,string>").isNull() | F.try_parse_json(F.col(payload)).isNull()
    return df.filter(bad).withColumns({"stage": F.lit("parse"), "topic": F.lit(topic), "error": F.substring(F.concat(F.lit("not a JSON object: "), F.coalesce(F.col(payload), F.lit("null"))), 1, 500), "payload": F.substring(F.coalesce(F.col(payload), F.lit("")), 1, 10_000), "retries": F.lit(0)})


def deterministic_event_id(topic: Column, partition: Column, offset: Column) -> Column:
    """UUID version 5 of a record's coordinates, so that a replay gives the same ids."""
    return uuid_v5(NAMESPACE, F.concat_ws(":", topic, partition.cast("string"), offset.cast("string")))


def fan_out(df: DataFrame, key: str, values: list[str]) -> dict[str, DataFrame]:
    """One frame for each value of the key; the last also takes what has none of them (A5)."""
    out = {v: df.filter(F.col(key) == v) for v in values[1:]}
    return {values[0]: df.filter(F.coalesce(~F.col(key).isin(*values[1:]), F.lit(True))), **out}


def append_sink(df: DataFrame, batch_id: int, root: str, key: str = "event_type", date: str = "ts") -> None:
    """Write a micro-batch to a folder of its own, partitioned by family and day.

    The folder is named by the batch and overwritten, so a batch that is run again leaves no rows twice.
    """
    df.withColumn("event_date", F.to_date(date)).write.mode("overwrite").partitionBy(key, "event_date").parquet(f"{root}/batch={batch_id}")


def publish(df: DataFrame, action: str = "action") -> DataFrame:
    """(topic, value) rows for a topic sink (A7): all scores, and those escalated to two more topics. The frame is
    read once: each row is exploded to its topics."""
    topics = F.when(F.col(action) == "escalate", F.array(F.lit("triage-scores"), F.lit("anomaly-alerts"), F.lit("hunter-tasks"))).otherwise(F.array(F.lit("triage-scores")))
    return df.select("*", F.explode(topics).alias("topic")).withColumn("value", F.to_json(F.struct(*df.columns)))


def hunter_task(scores: DataFrame, stages: DataFrame, host: str = "host") -> DataFrame:
    """Escalated scores with the host's attack stage, as investigation payloads."""
    latest = stages.groupBy(host).agg(F.max_by("chain_stage", "us").alias("chain_stage"), F.max_by("chain_velocity", "us").alias("chain_velocity"))
    return scores.filter("action = 'escalate'").join(latest, host, "left").fillna(0, ["chain_stage", "chain_velocity"])


def sync_since(df: DataFrame, ts: str, key: str, watermark: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The next rows after a watermark in order of (ts, key), and the frame of the new watermark."""
    rows = df.filter(F.col(ts) > watermark).orderBy(ts, key).limit(limit)
    return rows, rows.agg(F.max(ts).alias("watermark"))


#: Column mappings of labelled data sets (A10, A14): name to column expressions over that set's own columns.
DATASETS = {
    "flows": {"duration": "try_cast(`Flow Duration` as double) / 1e6", "bytes_out": "try_cast(`Total Length of Fwd Packets` as double)", "bytes_in": "try_cast(`Total Length of Bwd Packets` as double)", "label": "`Label`"},
    "intrusions": {"duration": "try_cast(duration as double)", "bytes_out": "try_cast(src_bytes as double)", "bytes_in": "try_cast(dst_bytes as double)", "label": "class"},
    "network_attacks": {"duration": "try_cast(dur as double)", "bytes_out": "try_cast(sbytes as double)", "bytes_in": "try_cast(dbytes as double)", "label": "attack_cat"},
    "web_requests": {"duration": "0D", "bytes_out": "cast(length(content) as double)", "bytes_in": "0D", "label": "classification"},
    "windows_events": {"duration": "0D", "bytes_out": "0D", "bytes_in": "0D", "label": "coalesce(EVTX_Tactic, 'normal')"},
    "dns": {"duration": "0D", "bytes_out": "cast(length(query) as double)", "bytes_in": "0D", "label": "label"},
    "plain_logs": {"duration": "0D", "bytes_out": "cast(length(Content) as double)", "bytes_in": "0D", "label": "if(rlike(lower(Content), 'fail|attack|denied|invalid'), 'attack', 'normal')"},
}


def map_dataset(df: DataFrame, mapping: dict[str, str], source: str) -> DataFrame:
    """Common columns plus label, attack_type and source from a labelled data set."""
    from logloom.functions.normalize import normalize_labels

    mapped = df.selectExpr(*[f"{e} as {n}" for n, e in mapping.items()])
    label = normalize_labels(F.col("label"))
    return mapped.withColumn("_l", label).select(*[n for n in mapping if n != "label"], F.col("_l.label").alias("label"), F.col("_l.attack_type").alias("attack_type"), F.lit(source).alias("source"))


def read_csv_dataset(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A labelled data set in CSV with a header, by its mapping (A10)."""
    return map_dataset(spark.read.option("header", True).csv(path), DATASETS[name], name)


def markdown_row(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def export_report(df: DataFrame, fmt: str, path: str, history: str | None = None) -> None:
    """A report as CSV, JSON or Markdown, and a row of its history."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "markdown":
        df.select(markdown_row(df.columns).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no such format: {fmt}")
    if history is not None:
        df.agg(F.count("*").alias("rows")).select(F.current_timestamp().alias("created"), F.lit(fmt).alias("format"), F.lit(path).alias("path"), "rows").write.mode("append").parquet(history)


def ttl_purge(df: DataFrame, us: str, as_of_us: Column, days: int) -> DataFrame:
    """Rows within their retention, with ``age_class``: hot under 7 days, warm under 30, else cold."""
    age = (as_of_us - F.col(us)) / 86_400_000_000
    return df.filter(age <= days).withColumn("age_class", F.when(age < 7, "hot").when(age < 30, "warm").otherwise("cold"))


def sink_json(fields: list[str]) -> Column:
    """A family's JSON record with just its fields."""
    return F.to_json(F.struct(*fields))
