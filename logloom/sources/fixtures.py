"""Security-log views over the driver's tables, as DataFrames and as SQL for DuckDB.

Every view derives its columns from the rows of ``events`` alone, so it grows with them. Times are kept without a
zone; ``us`` is the number of microseconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = (22, 53, 80, 443, 445, 3389, 8080, 161)
PROTOCOLS = ("tcp", "udp", "icmp")
SOURCES = ("sshd", "nginx", "kernel", "app")
LEVELS = ("INFO", "WARN", "error", "CRITICAL", "7", "emerg", "notice", "trace")
SEVERITY = {"error": 4, "purchase": 3, "signup": 2, "click": 1, "view": 0}
TACTIC = {"error": "credential-access", "purchase": "exfiltration", "signup": "persistence", "click": "discovery", "view": "execution"}
TECHNIQUE = {"error": "T1110", "purchase": "T1041", "signup": "T1136", "click": "T1046", "view": "T1059"}
#: Messages by k modulo their number; {u} user, {h} host, {s} source address, {d} destination, {p} port, {b} bytes, {k} k.
MESSAGES = (
    "Failed password for {u} from {s} port {p} ssh2",
    "Accepted publickey for {u} from {s} port {p}",
    "brute force suspected: account locked for {u}",
    "c2 beacon to {d}:{p} by malware on {h}",
    "unusual transfer of {b} bytes, large upload to {d}",
    "port scan from {s}",
    "lateral movement from {h} to {d}",
    "dns tunnel query from {s}",
    "iptables DROP src={s}:{k} dst={d}:{p} proto=UDP src_bytes={b} dst_bytes={k}",
    "sudo: {u} opened a root shell",
    "process started pid={k} command=/bin/sh",
    "tcp connect {s}:{k} -> {d}:{p}",
    "GET /page/{k} took {b} us",
)


def us_of(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def pick_of(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def map_of(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``ev`` view: one security-log record for each row of ``events``."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, user = F.col("k"), F.col("user_id")
    base = raw.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    ev = base.select(
        "*",
        us_of(F.col("ts")).alias("us"),
        F.concat(F.lit("host-"), user % 20).alias("host"),
        F.concat(F.lit("user-"), user).alias("usr"),
        F.concat(F.lit("10.0."), user % 8, F.lit("."), user % 250).alias("src_ip"),
        F.concat(F.lit("192.168."), k % 4, F.lit("."), k).alias("dst_ip"),
        pick_of(PORTS, k).alias("dst_port"),
        pick_of(PROTOCOLS, k).alias("protocol"),
        F.when(k % 2 == 0, "outbound").otherwise("inbound").alias("direction"),
        map_of(SEVERITY, F.col("event_type")).alias("severity"),
        map_of(TACTIC, F.col("event_type")).alias("tactic"),
        map_of(TECHNIQUE, F.col("event_type")).alias("technique"),
        F.round(F.col("value") * 100).cast("long").alias("bytes_out"),
        (k * 10).cast("long").alias("bytes_in"),
        (k * 7 % 50).alias("duration_ms"),
        F.least(F.col("value") / 200, F.lit(1.0)).alias("score"),
        ((k + 0.5) / 100).alias("score2"),
        ((k * 37 % 100 + 0.5) / 100).alias("score3"),
        pick_of(SOURCES, k).alias("source"),
        pick_of(LEVELS, k).alias("level"),
    )
    fills = {"u": "usr", "h": "host", "s": "src_ip", "d": "dst_ip", "p": "dst_port", "b": "bytes_out", "k": "k"}

    def filled(template: str) -> Column:
        parts, rest = [], template
        while "{" in rest:
            before, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(before), F.col(fills[name]).cast("string")]
        return F.concat(*parts, F.lit(rest))

    message = F.lit(None).cast("string")
    for i in range(len(MESSAGES) - 1, -1, -1):
        message = F.when(k % len(MESSAGES) == i, filled(MESSAGES[i])).otherwise(message)
    return ev.withColumn("message", message)


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def _sql_case(values: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + " END"


def _sql_message() -> str:
    fills = {"{u}": "usr", "{h}": "host", "{s}": "src_ip", "{d}": "dst_ip", "{p}": "dst_port", "{b}": "bytes_out", "{k}": "k"}
    out = []
    for i, template in enumerate(MESSAGES):
        text = "'" + template + "'"
        for mark, column in fills.items():
            text = text.replace(mark, f"' || {column} || '")
        out.append(f"WHEN {i} THEN {text}")
    return f"CASE k % {len(MESSAGES)} " + " ".join(out) + " END"


#: CTEs ``ev`` (without message) and ``logs`` (with it), to be followed by more CTEs or the query.
EV_SQL = f"""WITH base AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value, CAST(props->>'k' AS INTEGER) AS k FROM events
), ev AS (
  SELECT *, 'host-' || (user_id % 20) AS host, 'user-' || user_id AS usr,
    '10.0.' || (user_id % 8) || '.' || (user_id % 250) AS src_ip, '192.168.' || (k % 4) || '.' || k AS dst_ip,
    {_sql_list(PORTS)}[k % {len(PORTS)} + 1] AS dst_port, {_sql_list(PROTOCOLS)}[k % 3 + 1] AS protocol,
    CASE WHEN k % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction,
    {_sql_case(SEVERITY, "event_type")} AS severity, {_sql_case(TACTIC, "event_type")} AS tactic,
    {_sql_case(TECHNIQUE, "event_type")} AS technique,
    CAST(round(value * 100) AS BIGINT) AS bytes_out, CAST(k * 10 AS BIGINT) AS bytes_in, k * 7 % 50 AS duration_ms,
    least(value / 200, 1.0) AS score, (k + 0.5::DOUBLE) / 100 AS score2, (k * 37 % 100 + 0.5::DOUBLE) / 100 AS score3,
    {_sql_list(SOURCES)}[k % 4 + 1] AS source, {_sql_list(LEVELS)}[k % {len(LEVELS)} + 1] AS level
  FROM base
), logs AS (SELECT *, {_sql_message()} AS message FROM ev)
"""
