"""Queries of normalisation, classification and scalar features (inventory A, B, C) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import normalize as N
from logloom.functions import scalar as S
from logloom.plans.registry import query
from logloom.sources import ingest as I
from logloom.sources.fixtures import EV_SQL, log_events

LEVEL_SQL = """CASE WHEN upper(level) IN ('0','1','2') THEN 'CRITICAL' WHEN upper(level) = '3' THEN 'ERROR' WHEN upper(level) = '4' THEN 'WARNING' WHEN upper(level) IN ('5','6') THEN 'INFO' WHEN upper(level) = '7' THEN 'DEBUG'
  WHEN regexp_matches(upper(level), 'EMERG|CRIT|ALERT') THEN 'CRITICAL' WHEN regexp_matches(upper(level), 'ERR') THEN 'ERROR' WHEN regexp_matches(upper(level), 'WARN') THEN 'WARNING' WHEN regexp_matches(upper(level), 'DEBUG|TRACE') THEN 'DEBUG' ELSE 'INFO' END"""
RANK_SQL = f"CASE {LEVEL_SQL} WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 0 END"


def rx(pattern: str, text: str = "message") -> str:
    return f"regexp_matches({text}, '(?i){pattern}')"


def class_sql(pick: int, plain: str) -> str:
    cases = " ".join(f"WHEN {rx(r[0])} THEN {r[pick]!r}" for r in N.SECURITY_RULES)
    return f"CASE {cases} ELSE {plain} END"


TYPE_SQL = "CASE " + " ".join(f"WHEN {rx(r[0])} THEN 'security'" for r in N.SECURITY_RULES) + f" WHEN {rx(N.PROCESS_HINT)} THEN 'process' WHEN {rx(N.NETWORK_HINT)} THEN 'network' ELSE 'raw' END"


@query("b1_normalize_timestamp", EV_SQL + "SELECT event_id, CASE WHEN k % 5 = 0 THEN epoch_us(TIMESTAMP '2024-06-01') ELSE epoch_us(date_trunc('second', ts)) END AS at FROM ev")
def b1(spark, d):
    text = F.when(F.col("k") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return log_events(spark, d).select("event_id", N.normalize_timestamp(text, F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("at"))


@query("b2_merge_json_message", "SELECT event_id, coalesce(props->>'k', event_type) AS k, coalesce(props->>'missing', event_type) AS missing FROM events")
def b2(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select("event_id", N.merge_json_message(F.col("props"), "k", F.col("event_type")).alias("k"), N.merge_json_message(F.col("props"), "missing", F.col("event_type")).alias("missing"))


@query("b3_resolve_hostname", EV_SQL + "SELECT event_id, coalesce(CASE WHEN k % 2 = 0 THEN host END, CASE WHEN k % 3 = 0 THEN 'c' || k END, 'unknown') AS hostname FROM ev")
def b3(spark, d):
    ev = log_events(spark, d).select("event_id", F.when(F.col("k") % 2 == 0, F.col("host")).alias("hostname"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), "k")).alias("container_name"))
    return ev.select("event_id", N.resolve_hostname(ev).alias("hostname"))


@query("b4_extract_ip", EV_SQL + r"SELECT event_id, nullif(regexp_extract(message, '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b', 1), '') AS ip FROM logs")
def b4(spark, d):
    return log_events(spark, d).select("event_id", N.extract_ip(F.col("message")).alias("ip"))


@query("b5_normalize_level", EV_SQL + f"SELECT event_id, {LEVEL_SQL} AS level FROM ev")
def b5(spark, d):
    return log_events(spark, d).select("event_id", N.normalize_level(F.col("level")).alias("level"))


@query("b6_level_rank", EV_SQL + f"SELECT {RANK_SQL} AS rank, count(*) AS n FROM ev GROUP BY 1")
def b6(spark, d):
    return log_events(spark, d).groupBy(N.level_rank(F.col("level")).alias("rank")).agg(F.count("*").alias("n"))


@query("b7_strip_syslog_header", EV_SQL + "SELECT event_id, message AS body FROM logs")
def b7(spark, d):
    ev = log_events(spark, d)
    header = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), "host", F.lit(" app[12]: "), "message")
    return ev.select("event_id", N.strip_syslog_header(header).alias("body"))


@query("b8_classify_event", EV_SQL + f"SELECT event_id, {TYPE_SQL} AS event_type, {class_sql(1, 'NULL')} AS category, {class_sql(2, RANK_SQL)} AS severity, {class_sql(3, 'NULL')} AS tactic, {class_sql(4, 'NULL')} AS technique FROM logs")
def b8(spark, d):
    return log_events(spark, d).select("event_id", N.classify_event(F.col("message"), F.col("level")).alias("c")).select("event_id", "c.*")


@query("b9_sub_rules", EV_SQL + f"SELECT {class_sql(4, 'NULL')} AS technique, {class_sql(2, RANK_SQL)} AS severity, count(*) AS n FROM logs WHERE {rx('brute force|lateral movement|dns tunnel')} GROUP BY ALL")
def b9(spark, d):
    c = N.classify_event(F.col("message"), F.col("level"))
    ev = log_events(spark, d).filter(N.matches(F.col("message"), "brute force|lateral movement|dns tunnel"))
    return ev.groupBy(c["technique"].alias("technique"), c["severity"].alias("severity")).agg(F.count("*").alias("n"))


@query("b11_normalize_network", EV_SQL + "SELECT event_id, src_ip, CASE WHEN k % 4 = 0 THEN '0.0.0.0' ELSE dst_ip END AS dst_ip, CASE WHEN k % 7 = 0 THEN 0 ELSE dst_port END AS dst_port, upper(protocol) AS protocol, bytes_out AS bytes_sent, bytes_in AS bytes_received FROM ev")
def b11(spark, d):
    ev = log_events(spark, d)
    raw = ev.select("event_id", F.col("src_ip").alias("source_ip"), F.when(F.col("k") % 4 == 0, "fe80::1").otherwise(F.col("dst_ip")).alias("dest_ip"), F.when(F.col("k") % 7 == 0, 99999).otherwise(F.col("dst_port")).alias("dest_port"), F.col("protocol").alias("proto"), "bytes_out", "bytes_in")
    return N.normalize_network(raw).select("event_id", "src_ip", "dst_ip", "dst_port", "protocol", "bytes_sent", "bytes_received")


@query("b11_normalize_process", EV_SQL + "SELECT event_id, k AS pid, 0 AS ppid, 'host-' || (user_id % 20) AS binary_path, -1 AS exit_code FROM ev")
def b11p(spark, d):
    raw = log_events(spark, d).select("event_id", F.col("k").cast("string").alias("_PID"), F.lit("x").alias("ppid"), F.col("host").alias("exe"))
    return N.normalize_process(raw).select("event_id", "pid", "ppid", "binary_path", "exit_code")


@query("b12_build_metadata", EV_SQL + "SELECT event_id, 1 + (k % 2 = 0)::INT AS n, usr AS user_id, CASE WHEN k % 2 = 0 THEN src_ip END AS ip_address FROM ev")
def b12(spark, d):
    meta = N.build_metadata(user_id=F.col("usr"), ip_address=F.when(F.col("k") % 2 == 0, F.col("src_ip")))
    return log_events(spark, d).select("event_id", meta.alias("m")).select("event_id", F.size("m").alias("n"), F.col("m")["user_id"].alias("user_id"), F.col("m")["ip_address"].alias("ip_address"))


@query("b13_drop_debug", EV_SQL + f"SELECT count(*) AS n FROM (SELECT {TYPE_SQL} AS t, {LEVEL_SQL} AS l FROM logs) WHERE NOT (t = 'raw' AND l = 'DEBUG')")
def b13(spark, d):
    ev = log_events(spark, d)
    return N.drop_debug(ev.withColumn("event_type", N.classify_event(F.col("message"), F.col("level"))["event_type"])).agg(F.count("*").alias("n"))


WINDOWS_IDS = (4624, 4625, 4648, 4672, 4688, 4720, 1102, 9999)
WINDOWS_SQL = "[" + ", ".join(map(str, WINDOWS_IDS)) + "][k % 8 + 1]"


WINDOWS_CLASS_SQL = """(VALUES (4624, 'security', 'auth', 1, 'initial-access', 'T1078'), (4625, 'security', 'auth', 3, 'credential-access', 'T1110'), (4648, 'security', 'credential-access', 2, 'credential-access', 'T1078.002'),
  (4672, 'security', 'privilege-escalation', 2, 'privilege-escalation', 'T1134'), (4688, 'process', NULL, NULL, NULL, NULL), (4720, 'security', 'persistence', 3, 'persistence', 'T1136.001'), (1102, 'security', 'defense-evasion', 4, 'defense-evasion', 'T1070.001'), (9999, 'raw', NULL, NULL, NULL, NULL)) r(id, family, category, severity, tactic, technique)"""


@query("b14_classify_windows", EV_SQL + f"SELECT event_id, r.family, r.category, r.severity, r.tactic, r.technique FROM (SELECT event_id, {WINDOWS_SQL} AS w FROM ev) LEFT JOIN {WINDOWS_CLASS_SQL} ON r.id = w")
def b14(spark, d):
    ev = log_events(spark, d).select("event_id", F.element_at(F.array(*map(F.lit, WINDOWS_IDS)), F.col("k") % 8 + 1).alias("w"))
    return N.classify_windows_telemetry(ev, F.lit("Security"), F.col("w")).drop("w")


#: Channel, id and telling field of Windows events, and the class that each must get.
WINDOWS_CASES = (
    ("Sysmon", 1, None, "process", None, None, None, None),
    ("Sysmon", 2, None, "security", "defense-evasion", 3, "defense-evasion", "T1070.006"),
    ("Sysmon", 3, None, "network", None, None, None, None),
    ("Sysmon", 5, None, "process", None, None, None, None),
    ("Sysmon", 6, "true", "security", "persistence", 2, "persistence", "T1547.006"),
    ("Sysmon", 6, "false", "security", "persistence", 4, "persistence", "T1547.006"),
    ("Sysmon", 7, "false", "process", None, None, None, None),
    ("Sysmon", 8, None, "security", "defense-evasion", 4, "defense-evasion", "T1055"),
    ("Sysmon", 9, None, "security", "credential-access", 3, "credential-access", "T1003"),
    ("Sysmon", 10, "lsass.exe", "security", "credential-access", 4, "credential-access", "T1003.001"),
    ("Sysmon", 11, None, "raw", None, None, None, None),
    ("Sysmon", 12, "HKLM\\Software\\x", "security", "persistence", 3, "persistence", "T1547.001"),
    ("Sysmon", 13, "HKCU\\Software\\RunOnce", "security", "persistence", 4, "persistence", "T1547.001"),
    ("Sysmon", 14, "HKLM\\System\\Services\\x", "security", "persistence", 3, "persistence", "T1543.003"),
    ("Sysmon", 13, "HKLM\\Schedule\\TaskCache\\x", "security", "persistence", 3, "persistence", "T1053.005"),
    ("Sysmon", 12, "HKLM\\Image File Execution Options", "security", "persistence", 4, "defense-evasion", "T1546.012"),
    ("Sysmon", 13, "HKLM\\Windows Defender\\x", "security", "persistence", 4, "defense-evasion", "T1562.001"),
    ("Sysmon", 15, None, "security", "defense-evasion", 3, "defense-evasion", "T1564.004"),
    ("Sysmon", 17, "\\spoolss", "raw", None, None, None, None),
    ("Sysmon", 18, "\\PSEXESVC", "security", "command-and-control", 4, "command-and-control", "T1570"),
    ("Sysmon", 22, None, "network", None, None, None, None),
    ("Sysmon", 23, None, "raw", None, None, None, None),
    ("Sysmon", 24, None, "security", "collection", 3, "collection", "T1115"),
    ("Sysmon", 25, None, "security", "defense-evasion", 4, "defense-evasion", "T1055.012"),
    ("Sysmon", 26, None, "raw", None, None, None, None),
    ("Security", 4726, None, "security", "persistence", 3, "persistence", "T1136.001"),
    ("Security", 4732, None, "security", "privilege-escalation", 3, "privilege-escalation", "T1098"),
    ("Security", 4733, None, "security", "privilege-escalation", 3, "privilege-escalation", "T1098"),
    ("PowerShell", 4103, "Invoke-Mimikatz", "raw", None, None, None, None),
    ("PowerShell", 4104, "Get-Date", "raw", None, None, None, None),
    ("PowerShell", 4104, "Invoke-Mimikatz -enc", "security", "execution", 4, "execution", "T1003.001"),
    ("PowerShell", 4104, "iex (x)", "security", "execution", 4, "execution", "T1059.001"),
    ("PowerShell", 4104, "(New-Object Net.WebClient)", "security", "execution", 4, "execution", "T1105"),
    ("PowerShell", 4104, "FromBase64String", "security", "execution", 4, "execution", "T1059.001"),
    ("PowerShell", 4104, "Set-ExecutionPolicy\nBypass", "security", "execution", 4, "execution", "T1562.001"),
    ("PowerShell", 4104, "Add-Type [DllImport]", "security", "execution", 4, "execution", "T1106"),
    ("PowerShell", 4104, "VirtualAlloc", "security", "execution", 4, "execution", "T1055"),
    ("Application", 1, None, None, None, None, None, None),
)


def literal_rows(rows: tuple) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows) + ")"


@query("b14_windows_channels", EV_SQL + f"SELECT event_id, r.family, r.category, r.severity, r.tactic, r.technique FROM ev JOIN {literal_rows(tuple((i, *c[3:]) for i, c in enumerate(WINDOWS_CASES)))} r(i, family, category, severity, tactic, technique) ON r.i = k % {len(WINDOWS_CASES)}")
def b14b(spark, d):
    """All ids of all channels and the signs in their fields."""
    given = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(WINDOWS_CASES)], "i int, channel string, id int, sign string")
    ev = log_events(spark, d).select("event_id", (F.col("k") % len(WINDOWS_CASES)).alias("i")).join(F.broadcast(given), "i")
    return N.classify_windows_telemetry(ev, F.col("channel"), F.col("id"), F.col("sign")).drop("i", "channel", "id", "sign")


#: Program, arguments and parent of processes, and the rule that each must get.
PROCESS_CASES = (
    ("C:\\Windows\\System32\\certutil.exe", "-urlcache", "explorer.exe", "lolbin_certutil"),
    ("C:\\Windows\\WSL.exe", "", None, "lolbin_wsl"),
    ("C:\\Windows\\powershell.exe", "-NoP -w Hidden", "explorer.exe", "suspicious_powershell"),
    ("C:\\Windows\\powershell.exe", "Get-Date", "explorer.exe", None),
    ("C:\\Windows\\cmd.exe", "/c whoami & net group /domain", "explorer.exe", "recon_net_group"),
    ("C:\\Windows\\cmd.exe", "/c arp -a", "services.exe", "recon_arp_a"),
    ("C:\\tools\\procdump64.exe", "-ma lsass", "cmd.exe", "credential_dumping"),
    ("C:\\Windows\\rundll32.exe", "comsvcs.dll MiniDump", "cmd.exe", "credential_dumping"),
    ("C:\\Windows\\powershell.exe", "-enc AAAA; whoami", "C:\\Office\\WINWORD.EXE", "office_macro_spawn"),
    ("C:\\Windows\\notepad.exe", "a.txt", "C:\\Office\\EXCEL.EXE", None),
    ("C:\\Users\\Public\\x.exe", "ipconfig", "outlook.exe", "exec_from_suspicious_path"),
    (None, None, None, None),
)


@query("b15_suspicious_process", EV_SQL + f"SELECT event_id, r.rule FROM ev JOIN {literal_rows(tuple((i, c[3]) for i, c in enumerate(PROCESS_CASES)))} r(i, rule) ON r.i = k % {len(PROCESS_CASES)}")
def b15(spark, d):
    """One case of each rule, of rules that meet, and of none."""
    given = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(PROCESS_CASES)], "i int, binary string, arguments string, parent string")
    ev = log_events(spark, d).select("event_id", (F.col("k") % len(PROCESS_CASES)).alias("i")).join(F.broadcast(given), "i")
    return ev.select("event_id", N.suspicious_process(F.col("binary"), F.col("arguments"), F.col("parent")).alias("rule"))


@query("b16_parse_network_text", EV_SQL + r"""SELECT event_id, CASE k % 13 WHEN 8 THEN src_ip WHEN 11 THEN src_ip END AS src_ip, CAST(CASE k % 13 WHEN 8 THEN k WHEN 11 THEN k ELSE 0 END AS BIGINT) AS src_port, CASE k % 13 WHEN 8 THEN dst_ip WHEN 11 THEN dst_ip END AS dst_ip,
  CAST(CASE k % 13 WHEN 8 THEN dst_port WHEN 11 THEN dst_port ELSE 0 END AS BIGINT) AS dst_port, CASE k % 13 WHEN 8 THEN 'udp' END AS protocol, CAST(CASE k % 13 WHEN 8 THEN bytes_out ELSE 0 END AS BIGINT) AS bytes_sent, CAST(CASE k % 13 WHEN 8 THEN k ELSE 0 END AS BIGINT) AS bytes_received FROM ev""")
def b16(spark, d):
    return log_events(spark, d).select("event_id", N.parse_network_text(F.col("message")).alias("p")).select("event_id", "p.*")


ACTION_SQL = "CASE " + " ".join(f"WHEN {rx('\\b(?:' + w + ')\\b')} THEN {N.ACTION_CODES[a]}" for w, a in N.ACTION_WORDS) + " ELSE 0 END"


def action_code(df):
    none = F.lit(None).cast("string")
    return N.classify_action(F.col("message"), F.lit("raw-logs"), F.lit(None).cast("int"), none, none)


@query("b17_classify_action", EV_SQL + f"SELECT event_id, {ACTION_SQL} AS action_code FROM logs")
def b17(spark, d):
    ev = log_events(spark, d)
    return ev.select("event_id", action_code(ev).alias("action_code"))


@query("b18_admin_action", EV_SQL + f"SELECT event_id, {WINDOWS_SQL} IN (4672, 4720, 1102) OR k % 10 = 3 OR contains(lower(message), 'sudo') AS admin FROM logs")
def b18(spark, d):
    ev = log_events(spark, d).withColumn("w", F.element_at(F.array(*map(F.lit, WINDOWS_IDS)), F.col("k") % 8 + 1))
    none = F.lit(None).cast("string")
    return ev.select("event_id", N.admin_action(F.col("message"), F.col("w"), F.when(F.col("k") % 10 == 3, 10), none, none).alias("admin"))


@query("b19_event_risk", EV_SQL + f"SELECT event_id, round(CASE {WINDOWS_SQL} " + " ".join(f"WHEN {i} THEN {N.RISK_OF_WINDOWS[i]}" for i in WINDOWS_IDS if i in N.RISK_OF_WINDOWS) + " ELSE least(k / 10, 1.0) END, 6)::DOUBLE AS risk FROM ev")
def b19(spark, d):
    ev = log_events(spark, d).withColumn("w", F.element_at(F.array(*map(F.lit, WINDOWS_IDS)), F.col("k") % 8 + 1))
    return ev.select("event_id", N.event_risk(F.col("w"), F.col("k").cast("double"), F.col("level")).alias("risk"))


@query("b20_lookups", EV_SQL + "SELECT event_id, CASE protocol WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 ELSE 1 END AS protocol, CASE source WHEN 'nginx' THEN 8 ELSE 1 END AS source_type, CASE dst_port WHEN 22 THEN 'ssh' WHEN 53 THEN 'dns' WHEN 80 THEN 'http' WHEN 443 THEN 'https' WHEN 445 THEN 'smb' WHEN 3389 THEN 'rdp' WHEN 161 THEN 'snmp' ELSE 'port_' || dst_port END AS service, CASE lower(level) WHEN 'warn' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 WHEN 'notice' THEN 1 ELSE 0 END AS severity FROM ev")
def b20(spark, d):
    return log_events(spark, d).select("event_id", N.map_protocol(F.col("protocol")).alias("protocol"), N.map_source_type(F.col("source")).alias("source_type"), N.port_to_service(F.col("dst_port")).alias("service"), N.map_severity(F.col("level")).alias("severity"))


@query("b21_normalize_labels", EV_SQL + "SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label, CASE WHEN event_type = 'view' THEN 'normal' ELSE event_type END AS attack_type, count(*) AS n FROM ev GROUP BY ALL")
def b21(spark, d):
    raw = F.when(F.col("event_type") == "view", F.when(F.col("k") % 2 == 0, "BENIGN").otherwise(" Normal ")).otherwise(F.upper("event_type"))
    return log_events(spark, d).select(N.normalize_labels(raw).alias("l")).groupBy("l.label", "l.attack_type").agg(F.count("*").alias("n"))


@query("b22_search_events", EV_SQL + "SELECT event_id, us, host FROM logs WHERE contains(lower(concat_ws(' ', message, host)), 'root') AND severity >= 2 ORDER BY us DESC, event_id DESC LIMIT 50 OFFSET 10")
def b22(spark, d):
    return N.search_events(log_events(spark, d), "ROOT", ["message", "host"], "us", "event_id", min_severity=2, offset=10).select("event_id", "us", "host")


@query("b22_search_count", EV_SQL + "SELECT count(*) AS total FROM logs WHERE contains(lower(concat_ws(' ', message, host)), 'host-1')")
def b22b(spark, d):
    return N.search_count(log_events(spark, d), "HOST-1", ["message", "host"])


@query("b23_filter_investigations", EV_SQL + "SELECT event_id FROM logs WHERE severity >= 3 AND message ILIKE '%transfer%'")
def b23(spark, d):
    return log_events(spark, d).filter((F.col("severity") >= 3) & F.col("message").ilike("%transfer%")).select("event_id")


@query("c1_temporal_features", EV_SQL + "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, (hour(ts) < 6 OR hour(ts) >= 22 OR isodow(ts) >= 6)::INT AS off_hours FROM ev")
def c1(spark, d):
    return log_events(spark, d).select("event_id", S.temporal_features(F.col("ts")).alias("t")).select("event_id", "t.*")


@query("c2_char_entropy", EV_SQL + ", c AS (SELECT event_id, unnest(string_split(message, '')) AS ch, length(message) AS n FROM logs), g AS (SELECT event_id, ch, n, count(*) AS m FROM c GROUP BY ALL) SELECT event_id, round(-sum(m / n * log2(m / n)), 6) AS entropy FROM g GROUP BY event_id")
def c2(spark, d):
    return log_events(spark, d).select("event_id", S.char_entropy(F.col("message")).alias("entropy"))


@query("c3_text_stats", EV_SQL + r"SELECT event_id, round(log10(length(message) + 1), 6) AS length_log, round(length(regexp_replace(message, '[^0-9]', '', 'g')) / length(message), 6) AS digit_ratio, round(length(regexp_replace(message, '[A-Za-z0-9\s]', '', 'g')) / length(message), 6) AS special_ratio FROM logs")
def c3(spark, d):
    return log_events(spark, d).select("event_id", S.text_stats(F.col("message")).alias("t")).select("event_id", "t.*")


@query("c4_keyword_threat", EV_SQL + "SELECT event_id, round(ln(1 + " + " + ".join(f"contains(lower(message), '{w}')::INT" for w in S.THREAT_WORDS) + f") / ln({1 + len(S.THREAT_WORDS)}), 6) AS threat FROM logs")
def c4(spark, d):
    return log_events(spark, d).select("event_id", S.keyword_threat_score(F.col("message")).alias("threat"))


@query("c5_byte_features", EV_SQL + "SELECT event_id, least(bytes_out, 1e9)::DOUBLE AS sent, least(bytes_in, 1e9)::DOUBLE AS received, round(CASE WHEN bytes_out + bytes_in > 0 THEN bytes_out / (bytes_out + bytes_in) ELSE 0 END, 6)::DOUBLE AS ratio, round(log10(1 + bytes_out + bytes_in), 6) AS total_log FROM ev")
def c5(spark, d):
    return log_events(spark, d).select("event_id", S.byte_features(F.col("bytes_out"), F.col("bytes_in")).alias("b")).select("event_id", "b.*")


@query("c6_event_freq", EV_SQL + "SELECT event_id, round(CASE WHEN duration_ms > 0 THEN 60 / (duration_ms / 1000) ELSE 0 END, 6)::DOUBLE AS freq FROM ev")
def c6(spark, d):
    return log_events(spark, d).select("event_id", S.event_freq_1m(F.col("duration_ms") / 1000).alias("freq"))


@query("c7_connection_error", EV_SQL + "SELECT event_id, CASE WHEN lower(message) LIKE '%syn%' THEN 'syn_error' WHEN regexp_matches(lower(message), 'rst|reject|drop') THEN 'reject_error' WHEN bytes_in = 0 AND duration_ms < 1 THEN 'syn_error' ELSE 'none' END AS error FROM logs")
def c7(spark, d):
    return log_events(spark, d).select("event_id", S.connection_error_type(F.col("message"), F.col("bytes_in"), F.col("duration_ms")).alias("error"))


@query("c8_sanitize", EV_SQL + "SELECT event_id, round(CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN 1e9 ELSE value END, 6)::DOUBLE AS x FROM ev")
def c8(spark, d):
    raw = F.when(F.col("k") % 4 == 0, float("nan")).when(F.col("k") % 4 == 1, float("inf")).otherwise(F.col("value"))
    return log_events(spark, d).select("event_id", S.sanitize(raw).alias("x"))


@query("c9_z_scale", EV_SQL + "SELECT event_id, round((value - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) AS z FROM ev, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM ev)")
def c9(spark, d):
    ev = log_events(spark, d)
    stats = ev.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return ev.crossJoin(F.broadcast(stats)).select("event_id", S.z_scale(F.col("value"), F.col("m"), F.col("s")).alias("z"))


@query("c10_sigmoid", EV_SQL + "SELECT event_id, round(1 - 1 / (1 + exp((value - 50) / 20)), 6) AS p FROM ev")
def c10(spark, d):
    return log_events(spark, d).select("event_id", S.sigmoid_calibrate(F.col("value"), 50.0, 20.0, flip=True).alias("p"))


@query("c12_score_bucket", EV_SQL + "SELECT event_id, CAST(floor(score * 100 / 10) * 10 AS INTEGER) AS bucket FROM ev")
def c12(spark, d):
    return log_events(spark, d).select("event_id", S.score_bucket(F.col("score")).alias("bucket"))


@query("c13_severity_weight", EV_SQL + "SELECT host, CAST(sum(CASE severity WHEN 4 THEN 25 WHEN 3 THEN 10 WHEN 2 THEN 4 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS weight, round(max(severity) / 4 * 100, 6) AS confidence FROM ev GROUP BY host")
def c13(spark, d):
    return log_events(spark, d).groupBy("host").agg(F.sum(S.severity_weight(F.col("severity"))).alias("weight"), (F.max("severity") / 4 * 100).alias("confidence"))


@query("c14_classify_score", EV_SQL + "SELECT event_id, CASE WHEN score2 >= 0.95 THEN 'critical' WHEN score2 >= 0.85 THEN 'high' WHEN score2 >= 0.7 THEN 'medium' WHEN score2 >= 0.5 THEN 'low' ELSE 'info' END AS label, round(CASE WHEN score2 >= 0.5 THEN score2 ELSE 1 - score2 END, 6) AS confidence FROM ev")
def c14(spark, d):
    return log_events(spark, d).select("event_id", S.classify_score(F.col("score2")).alias("c")).select("event_id", "c.*")


@query("c15_recommended_action", EV_SQL + "SELECT event_id, host || ': ' || CASE WHEN score2 >= 0.95 THEN 'isolate host and open incident' WHEN score2 >= 0.85 THEN 'investigate at once' WHEN score2 >= 0.7 THEN 'review within a day' WHEN score2 >= 0.5 THEN 'watch' ELSE 'none' END AS action FROM ev")
def c15(spark, d):
    return log_events(spark, d).select("event_id", S.recommended_action(S.classify_score(F.col("score2"))["label"], F.col("host")).alias("action"))


@query("c16_narrative", EV_SQL + "SELECT event_id, 'host: ' || host || CASE WHEN severity >= 3 THEN chr(10) || 'tactic: ' || tactic ELSE '' END AS story FROM ev")
def c16(spark, d):
    return log_events(spark, d).select("event_id", S.narrative(host=F.col("host"), tactic=F.when(F.col("severity") >= 3, F.col("tactic"))).alias("story"))


@query("c17_parse_attributions", "SELECT event_id, 1 AS n, 'k' AS feature, CAST(props->>'k' AS DOUBLE) AS value FROM events")
def c17(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select("event_id", S.parse_attributions(F.col("props")).alias("a")).select("event_id", F.size("a").alias("n"), F.col("a")[0]["feature"].alias("feature"), F.col("a")[0]["value"].alias("value"))


@query("c18_embedding_text", EV_SQL + "SELECT event_id, source || ' ' || event_type || ' ' || message AS text FROM logs")
def c18(spark, d):
    return log_events(spark, d).select("event_id", S.embedding_text(F.col("source"), F.col("event_type"), F.col("message")).alias("text"))


@query("c19_model_freshness", EV_SQL + "SELECT event_id, CASE WHEN n <= 7 THEN 'fresh' WHEN n <= 30 THEN 'acceptable' WHEN n <= 90 THEN 'stale' ELSE 'outdated' END AS freshness FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS n FROM ev)")
def c19(spark, d):
    return log_events(spark, d).select("event_id", S.model_freshness(F.to_date("ts"), F.lit("2024-02-01").cast("date")).alias("freshness"))


@query("c20_mask_tokens", EV_SQL + r"""SELECT template, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '(^|[^A-Za-z0-9])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}([^A-Za-z0-9]|$)', '\1<IP>\2', 'g'), '([^A-Za-z0-9.])\d{5,}([^A-Za-z0-9.:]|$)', '\1<NUM>\2', 'g'), '(/[A-Za-z0-9_.-]+){3,}', '<PATH>', 'g'), ':\d{2,5}([^0-9]|$)', ':<PORT>\1', 'g') AS template FROM logs) GROUP BY template""")
def c20(spark, d):
    return log_events(spark, d).groupBy(S.mask_tokens(F.col("message")).alias("template")).agg(F.count("*").alias("n"))


@query("a2_parse_records", "SELECT event_id, coalesce(try_cast(props->>'k' AS INTEGER), -1) AS pid, 'unknown' AS hostname, 'INFO' AS level FROM events")
def a2(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return I.parse_records(ev, "props", {"pid": (["pid", "k"], "int", -1), "hostname": (["hostname", "host"], "string", "unknown"), "level": (["level"], "string", "INFO")}, keep=["event_id"])


@query("a3_dead_letter", EV_SQL + "SELECT event_id, 'parse' AS stage, 'not json: ' || k AS payload, 0 AS retries FROM ev WHERE k % 10 = 0")
def a3(spark, d):
    ev = log_events(spark, d)
    raw = ev.select("event_id", F.when(F.col("k") % 10 == 0, F.concat(F.lit("not json: "), "k")).otherwise(F.concat(F.lit('{"k": '), "k", F.lit("}"))).alias("payload"))
    return I.dead_letters(raw, "payload", "events").select("event_id", "stage", "payload", "retries")


@query("a4_deterministic_event_id")
def a4(spark, d):
    return log_events(spark, d).select("event_id", I.deterministic_event_id(F.lit("events"), F.col("k") % 12, F.col("event_id")).alias("uuid"))


@query("a5_fan_out", EV_SQL + f"SELECT {TYPE_SQL} AS event_type, count(*) AS n FROM logs GROUP BY 1")
def a5(spark, d):
    ev = log_events(spark, d)
    ev = ev.withColumn("event_type", N.classify_event(F.col("message"), F.col("level"))["event_type"])
    parts = I.fan_out(ev, "event_type", ["raw", "security", "process", "network"])
    out = None
    for name, part in parts.items():
        one = part.groupBy(F.lit(name).alias("event_type")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a7_publish", EV_SQL + """SELECT event_id, CASE WHEN score >= 0.95 THEN 3 ELSE 1 END AS topics FROM ev""")
def a7(spark, d):
    ev = log_events(spark, d).withColumn("action", F.when(F.col("score") >= 0.95, "escalate").otherwise("discard"))
    return I.publish(ev.select("event_id", "score", "action")).groupBy("event_id").agg(F.count("*").cast("int").alias("topics"))


@query("a9_sync_since", EV_SQL + "SELECT event_id, us FROM ev WHERE us > (SELECT quantile_disc(us, 0.5) FROM ev) ORDER BY us, event_id LIMIT 1000")
def a9(spark, d):
    ev = log_events(spark, d)
    middle = ev.agg(F.percentile_disc("us", F.lit(0.5)) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY us)")).first()[0]
    return I.sync_since(ev, "us", "event_id", int(middle), 1000)[0].select("event_id", "us")


@query("a12_ttl_purge", EV_SQL + "SELECT age_class, count(*) AS n FROM (SELECT CASE WHEN age < 7 THEN 'hot' WHEN age < 30 THEN 'warm' ELSE 'cold' END AS age_class FROM (SELECT (epoch_us(TIMESTAMP '2024-02-01') - us) / 86400000000 AS age FROM ev) WHERE age <= 20) GROUP BY 1")
def a12(spark, d):
    kept = I.ttl_purge(log_events(spark, d), "us", F.lit(1706745600000000), 20)
    return kept.groupBy("age_class").agg(F.count("*").alias("n"))


@query("a13_sink_json", EV_SQL + """SELECT event_id, '{"host":"' || host || '","severity":' || severity || '}' AS json FROM ev""")
def a13(spark, d):
    return log_events(spark, d).select("event_id", I.sink_json(["host", "severity"]).alias("json"))


@query("a11_export_report", EV_SQL + "SELECT '| ' || host || ' | ' || n || ' |' AS line FROM (SELECT host, count(*) AS n FROM ev GROUP BY host)")
def a11(spark, d):
    counts = log_events(spark, d).groupBy("host").agg(F.count("*").alias("n"))
    return counts.select(I.markdown_row(["host", "n"]).alias("line"))


@query("b10_default_severity", EV_SQL + f"SELECT event_id, {RANK_SQL} AS severity FROM logs WHERE {TYPE_SQL} <> 'security'")
def b10(spark, d):
    """Events that are not security events take their severity from the level."""
    ev = log_events(spark, d).withColumn("c", N.classify_event(F.col("message"), F.col("level")))
    return ev.filter("c.event_type <> 'security'").select("event_id", F.col("c.severity").alias("severity"))


@query("c11_like_match", EV_SQL + "SELECT event_id, host ILIKE ('HOST-' || (k % 3) || '%') AS hit FROM ev")
def c11(spark, d):
    return log_events(spark, d).select("event_id", S.like_match(F.col("host"), F.concat(F.lit("HOST-"), F.col("k") % 3, F.lit("%"))).alias("hit"))


@query("a6_append_sink", EV_SQL + f"SELECT {TYPE_SQL} AS event_type, CAST(ts AS DATE)::VARCHAR AS event_date, count(*) AS n FROM logs GROUP BY ALL")
def a6(spark, d):
    """Two micro-batches, one of them written twice, are read back whole and once."""
    from logloom.plans.stream_plans import shared_root

    root = shared_root(spark)
    ev = log_events(spark, d)
    ev = ev.withColumn("event_type", N.classify_event(F.col("message"), F.col("level"))["event_type"]).select("event_id", "ts", "event_type", "k")
    for batch in (0, 1, 1):
        I.append_sink(ev.filter(F.col("k") % 2 == batch), batch, root)
    return spark.read.parquet(root).groupBy("event_type", F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("n"))


@query("a8_hunter_task", EV_SQL + ", s AS (SELECT host, max_by(k, us) AS chain_stage FROM ev GROUP BY host) SELECT event_id, chain_stage FROM ev JOIN s USING (host) WHERE score >= 0.95")
def a8(spark, d):
    ev = log_events(spark, d).withColumn("action", F.when(F.col("score") >= 0.95, "escalate").otherwise("discard"))
    stages = ev.select("host", "us", F.col("k").alias("chain_stage"), F.lit(0.0).alias("chain_velocity"))
    return I.hunter_task(ev.select("event_id", "host", "action"), stages).select("event_id", "chain_stage")


@query("a10_map_dataset", EV_SQL + "SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label, CASE WHEN event_type = 'view' THEN 'normal' ELSE event_type END AS attack_type, 'intrusions' AS source, count(*) AS n, round(sum(bytes_out), 6)::DOUBLE AS bytes_out FROM ev GROUP BY ALL")
def a10(spark, d):
    """The log rows in the columns of a labelled intrusion set, through its mapping."""
    raw = log_events(spark, d).select(F.col("duration_ms").cast("string").alias("duration"), F.col("bytes_out").cast("string").alias("src_bytes"), F.col("bytes_in").cast("string").alias("dst_bytes"), F.when(F.col("event_type") == "view", "normal").otherwise(F.col("event_type")).alias("class"))
    out = I.map_dataset(raw, I.DATASETS["intrusions"], "intrusions")
    return out.groupBy("label", "attack_type", "source").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out"))


@query("e4_sketch_merge")
def e4_sketch(spark, d):
    """Distinct actions by mergeable sketches, two halves merged: approximate, so without SQL."""
    from logloom.operators import rollups as R

    ev = log_events(spark, d)
    part = lambda df: R.entity_frequency(df, ["host"], "event_type", sketch=True)
    merged = R.merge_rollup(part(ev.filter("k < 50")), part(ev.filter("k >= 50")), ["minute", "host"], sums=["events"], sketches=["actions_sketch"])
    return merged.select("minute", "host", "events", F.hll_sketch_estimate("actions_sketch").alias("unique_actions"))
