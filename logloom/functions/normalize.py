"""Normalisation and classification of log records, as column expressions (inventory B)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"

# The classes that records are sorted into, first match wins. Patterns are tried on the first 512
# characters, without regard to case: (pattern, category, severity, tactic, technique).
SECURITY_RULES = (
    ("brute force|account locked", "auth", 4, "credential-access", "T1110"),
    ("failed password|authentication failure|invalid user|login failed|access denied", "auth", 3, "credential-access", "T1078"),
    ("accepted password|accepted publickey|session opened|login successful", "auth", 1, "initial-access", "T1078"),
    ("malware|virus|trojan|ransomware|cryptominer|reverse shell|c2 beacon", "malware", 4, "execution", "T1059"),
    ("exfiltration|data leak|large upload|unusual transfer", "exfiltration", 4, "exfiltration", "T1041"),
    ("dns tunnel", "network-attack", 3, "command-and-control", "T1071.004"),
    ("lateral movement", "network-attack", 3, "lateral-movement", "T1021"),
    ("port scan|syn flood|ddos", "network-attack", 3, "discovery", "T1046"),
    ("firewall|iptables|nftables", "firewall", 2, "defense-evasion", "T1562"),
    (r"\bsudo[\s:\[]\b|privilege.escalat|\bsu:\s", "privilege-escalation", 2, "privilege-escalation", "T1548"),
    ("blocked.*connection|connection.*blocked", "firewall", 2, "defense-evasion", "T1562"),
)
PROCESS_HINT = "exec.*pid|process started|command=|comm="
NETWORK_HINT = r"(?:tcp|udp)\s+(?:connect|listen|accept)|connection\s+\S*\s*(?:port|:)"
#: Levels by number, and the severity of records that are not security events.
LEVEL_OF_DIGIT = {"0": "CRITICAL", "1": "CRITICAL", "2": "CRITICAL", "3": "ERROR", "4": "WARNING", "5": "INFO", "6": "INFO", "7": "DEBUG"}
LEVEL_WORDS = (("EMERG|CRIT|ALERT", "CRITICAL"), ("ERR", "ERROR"), ("WARN", "WARNING"), ("DEBUG|TRACE", "DEBUG"))
SEVERITY_OF_LEVEL = {"CRITICAL": 4, "ERROR": 3, "WARNING": 2}


def lookup(values: dict, key: Column) -> Column:
    """The value of a literal map at ``key``; null if it has none."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """An ordered decision list."""
    chain = F.when(*cases[0])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def normalize_timestamp(text: Column, as_of: Column) -> Column:
    """A time from ISO-8601 text, or ``as_of`` (B1)."""
    return F.coalesce(F.try_to_timestamp(text), as_of)


def resolve_alias(df: DataFrame, names: list[str], default) -> Column:
    """The first non-null of the columns that exist, or a default."""
    return F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(default))


def resolve_hostname(df: DataFrame) -> Column:
    return resolve_alias(df, ["hostname", "host", "container_name", "_HOSTNAME"], "unknown")


def extract_ip(text: Column) -> Column:
    """The first dotted quad of a text; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", 1), F.lit(""))


def normalize_level(level: Column) -> Column:
    """One of CRITICAL, ERROR, WARNING, INFO, DEBUG."""
    upper = F.upper(F.trim(F.coalesce(level, F.lit("INFO"))))
    words = [(upper.rlike(pattern), F.lit(name)) for pattern, name in LEVEL_WORDS]
    return F.coalesce(lookup(LEVEL_OF_DIGIT, upper), first_match(words, F.lit("INFO")))


def level_rank(level: Column) -> Column:
    """0 to 4 of a level before classification."""
    return F.coalesce(lookup(SEVERITY_OF_LEVEL, normalize_level(level)), F.lit(0))


def strip_syslog_header(text: Column) -> Column:
    """A message without the leading syslog or ISO header."""
    bare = F.regexp_replace(text, r"^\w{3}\s+\d{1,2}\s+[\d:]+\s+\S+\s+\S+?(?:\[\d+\])?:\s*", "")
    return F.regexp_replace(bare, r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}\S*\s+\S+[\s:]+", "")


def merge_json_message(message: Column, field: str, current: Column) -> Column:
    """A field of a record after a JSON object in its message has been laid over it (B2)."""
    parsed = F.when(F.ltrim(message).startswith("{"), F.get_json_object(message, f"$.{field}"))
    return F.coalesce(parsed, current)


def classify_event(text: Column, level: Column, label: Column | None = None, has_process: Column | None = None, has_network: Column | None = None) -> Column:
    """Struct of event_type, category, severity, tactic and technique.

    A label other than benign ones makes a security event; then the security rules, then process and network fields
    or hints; the rest is raw. Other than security events take their severity from the level.
    """
    scan = F.substring(F.coalesce(text, F.lit("")), 1, 512)

    def outcome(kind: str, category, severity, tactic, technique) -> Column:
        as_text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
        return F.struct(F.lit(kind).alias("event_type"), as_text(category).alias("category"), (severity if isinstance(severity, Column) else F.lit(severity)).cast("int").alias("severity"), as_text(tactic).alias("tactic"), as_text(technique).alias("technique"))

    plain = level_rank(level)
    cases = []
    if label is not None:
        low = F.lower(label)
        cases.append((F.coalesce(~low.isin("", "benign", "normal", "0"), F.lit(False)), outcome("security", low, 3, "unknown", "")))
    cases += [(matches(scan, pattern), outcome("security", *rest)) for pattern, *rest in SECURITY_RULES]
    for given, hint, kind in ((has_process, PROCESS_HINT, "process"), (has_network, NETWORK_HINT, "network")):
        if given is not None:
            cases.append((given, outcome(kind, None, plain, None, None)))
    cases += [(matches(scan, hint), outcome(kind, None, plain, None, None)) for hint, kind in ((PROCESS_HINT, "process"), (NETWORK_HINT, "network"))]
    return first_match(cases, outcome("raw", None, plain, None, None))


def valid_ip(ip: Column) -> Column:
    return F.when(ip.rlike(IPV4), ip).otherwise(F.lit("0.0.0.0"))


def valid_port(port: Column) -> Column:
    number = port.try_cast("int")
    return F.when(number.between(0, 65535), number).otherwise(F.lit(0))


def normalize_network(df: DataFrame) -> DataFrame:
    """Network fields under one name each, with defaults and checked addresses and ports."""
    number = lambda names: F.coalesce(resolve_alias(df, names, None).try_cast("long"), F.lit(0))
    return df.withColumns({
        "src_ip": valid_ip(resolve_alias(df, ["src_ip", "source_ip", "client_ip"], "0.0.0.0")),
        "dst_ip": valid_ip(resolve_alias(df, ["dst_ip", "dest_ip", "destination_ip", "server_ip"], "0.0.0.0")),
        "src_port": valid_port(resolve_alias(df, ["src_port", "source_port", "client_port"], 0)),
        "dst_port": valid_port(resolve_alias(df, ["dst_port", "dest_port", "destination_port", "server_port"], 0)),
        "protocol": F.upper(resolve_alias(df, ["protocol", "proto"], "TCP")),
        "direction": resolve_alias(df, ["direction"], "outbound"),
        "bytes_sent": number(["bytes_sent", "bytes_out"]),
        "bytes_received": number(["bytes_received", "bytes_in"]),
        "duration_ms": number(["duration_ms", "duration"]),
    })


def normalize_process(df: DataFrame) -> DataFrame:
    """Process fields under one name each."""
    number = lambda names, default: F.coalesce(resolve_alias(df, names, None).try_cast("int"), F.lit(default))
    return df.withColumns({
        "pid": number(["pid", "PID", "_PID"], 0),
        "ppid": number(["ppid", "PPID"], 0),
        "uid": number(["uid", "UID", "_UID"], 0),
        "gid": number(["gid", "GID"], 0),
        "binary_path": resolve_alias(df, ["binary_path", "exe", "_EXE", "COMM"], ""),
        "arguments": resolve_alias(df, ["arguments", "cmdline", "_CMDLINE"], ""),
        "exit_code": number(["exit_code", "EXIT_STATUS"], -1),
    })


def build_metadata(**fields: Column) -> Column:
    """Map of the fields that are present."""
    pairs = [x for name, c in fields.items() for x in (F.lit(name), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def drop_debug(df: DataFrame, event_type: str = "event_type", level: str = "level") -> DataFrame:
    """Without the raw records of level DEBUG."""
    return df.filter(~((F.col(event_type) == "raw") & (normalize_level(F.col(level)) == "DEBUG")))


# Windows channels and event ids with family, category, severity, tactic and technique; other ids of these
# channels are raw records.
WINDOWS_EVENTS = (
    ("sysmon", 1, "process", None, None, None, None),
    ("sysmon", 2, "security", "defense-evasion", 3, "defense-evasion", "T1070.006"),
    ("sysmon", 3, "network", None, None, None, None),
    ("sysmon", 5, "process", None, None, None, None),
    ("sysmon", 6, "security", "persistence", 2, "persistence", "T1547.006"),
    ("sysmon", 7, "process", None, None, None, None),
    ("sysmon", 8, "security", "defense-evasion", 4, "defense-evasion", "T1055"),
    ("sysmon", 9, "security", "credential-access", 3, "credential-access", "T1003"),
    ("sysmon", 10, "security", "credential-access", 4, "credential-access", "T1003.001"),
    ("sysmon", 12, "security", "persistence", 3, "persistence", "T1547.001"),
    ("sysmon", 13, "security", "persistence", 3, "persistence", "T1547.001"),
    ("sysmon", 14, "security", "persistence", 3, "persistence", "T1547.001"),
    ("sysmon", 15, "security", "defense-evasion", 3, "defense-evasion", "T1564.004"),
    ("sysmon", 22, "network", None, None, None, None),
    ("sysmon", 24, "security", "collection", 3, "collection", "T1115"),
    ("sysmon", 25, "security", "defense-evasion", 4, "defense-evasion", "T1055.012"),
    ("security", 4624, "security", "auth", 1, "initial-access", "T1078"),
    ("security", 4625, "security", "auth", 3, "credential-access", "T1110"),
    ("security", 4648, "security", "credential-access", 2, "credential-access", "T1078.002"),
    ("security", 4672, "security", "privilege-escalation", 2, "privilege-escalation", "T1134"),
    ("security", 4688, "process", None, None, None, None),
    ("security", 4720, "security", "persistence", 3, "persistence", "T1136.001"),
    ("security", 4726, "security", "persistence", 3, "persistence", "T1136.001"),
    ("security", 4732, "security", "privilege-escalation", 3, "privilege-escalation", "T1098"),
    ("security", 4733, "security", "privilege-escalation", 3, "privilege-escalation", "T1098"),
    ("security", 1102, "security", "defense-evasion", 4, "defense-evasion", "T1070.001"),
)
WINDOWS_CHANNELS = ("sysmon", "security", "powershell")
# Signs in an event's telling field (whether a driver is signed, registry key, pipe, script) that change its
# class, first match wins: channel, ids, pattern, then the columns of WINDOWS_EVENTS.
WINDOWS_SIGNS = (
    ("sysmon", (6,), "^false$", "security", "persistence", 4, "persistence", "T1547.006"),
    ("sysmon", (12, 13, 14), r"\\run", "security", "persistence", 4, "persistence", "T1547.001"),
    ("sysmon", (12, 13, 14), r"\\services\\", "security", "persistence", 3, "persistence", "T1543.003"),
    ("sysmon", (12, 13, 14), r"\\schedule\\taskcache", "security", "persistence", 3, "persistence", "T1053.005"),
    ("sysmon", (12, 13, 14), r"\\image file execution", "security", "persistence", 4, "defense-evasion", "T1546.012"),
    ("sysmon", (12, 13, 14), r"\\windows defender", "security", "persistence", 4, "defense-evasion", "T1562.001"),
    ("sysmon", (17, 18), r"\\msse-|\\psexesvc|\\msagent_|\\postex_", "security", "command-and-control", 4, "command-and-control", "T1570"),
    ("powershell", (4104,), "invoke-mimikatz|sekurlsa", "security", "execution", 4, "execution", "T1003.001"),
    ("powershell", (4104,), r"invoke-expression|iex\(|iex \(", "security", "execution", 4, "execution", "T1059.001"),
    ("powershell", (4104,), "downloadstring|downloadfile|webclient|invoke-webrequest", "security", "execution", 4, "execution", "T1105"),
    ("powershell", (4104,), "-enc|encodedcommand|frombase64", "security", "execution", 4, "execution", "T1059.001"),
    ("powershell", (4104,), "(?s)bypass.*executionpolicy|executionpolicy.*bypass", "security", "execution", 4, "execution", "T1562.001"),
    ("powershell", (4104,), "(?s)add-type.*dllimport|dllimport.*add-type", "security", "execution", 4, "execution", "T1106"),
    ("powershell", (4104,), "invoke-shellcode|virtualalloc|createthread", "security", "execution", 4, "execution", "T1055"),
)


def classify_windows_telemetry(df: DataFrame, channel: Column, event_id: Column, sign: Column | None = None) -> DataFrame:
    """``df`` with family, category, severity, tactic and technique of Windows events, by a small rule table.

    ``sign`` is the event's telling field, if there is one. Ids without a rule are raw in the known channels; other
    channels have no family.
    """
    names = ("family", "category", "severity", "tactic", "technique")
    rules = df.sparkSession.createDataFrame(WINDOWS_EVENTS, "_channel string, _id int, family string, category string, severity int, tactic string, technique string")
    low = F.lower(channel)
    out = df.withColumns({"_low": low, "_event": event_id, "_sign": sign if sign is not None else F.lit(None).cast("string")})
    out = out.join(F.broadcast(rules), (F.col("_low") == F.col("_channel")) & (F.col("_event") == F.col("_id")), "left")
    struct = lambda values: F.struct(*[(F.lit(v) if not isinstance(v, Column) else v).cast("int" if n == "severity" else "string").alias(n) for n, v in zip(names, values, strict=True)])
    known = F.coalesce(F.col("family"), F.when(F.col("_low").isin(*WINDOWS_CHANNELS), F.lit("raw")))
    plain = struct((known, *map(F.col, names[1:])))
    cases = [((F.col("_low") == kind) & F.col("_event").isin(*ids) & matches(F.col("_sign"), pattern), struct(rest)) for kind, ids, pattern, *rest in WINDOWS_SIGNS]
    picked = out.withColumn("_class", first_match(cases, plain))
    return picked.withColumns({n: F.col("_class")[n] for n in names}).drop("_class", "_channel", "_id", "_low", "_event", "_sign")


# Programs, commands and paths that make a process suspicious.
LOLBINS = ("certutil", "mshta", "regsvr32", "rundll32", "wscript", "cscript", "msbuild", "installutil", "regasm", "regsvcs", "eventvwr", "fodhelper", "cmstp", "msconfig", "dfsvc", "ieexec", "control", "pcalua", "forfiles", "bash", "wsl", "bitsadmin", "xwizard")
RECON = ("whoami", "net user", "net group", "net localgroup", "ipconfig", "systeminfo", "tasklist", "netstat", "nltest", "dsquery", "arp -a", "nslookup", "net share", "qprocess", "quser")
SHELL_OPTIONS = "-enc|-encodedcommand|hidden|-nop|bypass"
OFFICE_PROGRAMS = r"(?:winword|excel|powerpnt|outlook)\.exe$"
OFFICE_CHILDREN = r"(?:cmd|powershell|wscript|cscript|mshta)\.exe$"
ODD_PATHS = r"\\temp\\|\\tmp\\|\\downloads\\|\\users\\public\\"


def suspicious_process(binary: Column, arguments: Column, parent: Column) -> Column:
    """Name of the process rule that holds; of several the one that says most, null if none.

    From the strongest on: an odd path, a shell started by an office program, a credential tool, reconnaissance (the
    last of its commands), a shell with hiding options, a program of the system that runs others' code.
    """
    text = [F.lower(F.coalesce(c, F.lit(""))) for c in (binary, arguments, parent)]
    path, said, above = text
    credentials = matches(path, "mimikatz|procdump|lazagne") | F.contains(said, F.lit("sekurlsa")) | (F.contains(path, F.lit("rundll32")) & F.contains(said, F.lit("comsvcs.dll")))
    recon = F.coalesce(*[F.when(F.contains(said, F.lit(c)), F.lit("recon_" + c.replace(" ", "_").replace("-", ""))) for c in reversed(RECON)])
    program = F.regexp_extract(path, rf"({'|'.join(LOLBINS)})\.exe$", 1)
    return F.coalesce(
        F.when(matches(path, ODD_PATHS), F.lit("exec_from_suspicious_path")),
        F.when(matches(above, OFFICE_PROGRAMS) & matches(path, OFFICE_CHILDREN), F.lit("office_macro_spawn")),
        F.when(credentials, F.lit("credential_dumping")),
        recon,
        F.when(matches(path, r"(?:powershell|pwsh)\.exe$") & matches(said, SHELL_OPTIONS), F.lit("suspicious_powershell")),
        F.when(program != "", F.concat(F.lit("lolbin_"), program)),
    )


def parse_network_text(text: Column) -> Column:
    """Struct of addresses, ports, protocol and bytes from free text."""
    arrow = r"(\d{1,3}(?:\.\d{1,3}){3}):(\d+)\s*->\s*(\d{1,3}(?:\.\d{1,3}){3}):(\d+)"
    pair = lambda side, group: F.regexp_extract(text, side + r"=(\d{1,3}(?:\.\d{1,3}){3})(?::(\d+))?", group)
    filled = lambda *choices: F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])
    number = lambda *choices: F.coalesce(filled(*choices).try_cast("long"), F.lit(0))
    return F.struct(
        filled(F.regexp_extract(text, arrow, 1), pair("src", 1)).alias("src_ip"),
        number(F.regexp_extract(text, arrow, 2), pair("src", 2)).alias("src_port"),
        filled(F.regexp_extract(text, arrow, 3), pair("dst", 1)).alias("dst_ip"),
        number(F.regexp_extract(text, arrow, 4), pair("dst", 2)).alias("dst_port"),
        F.lower(filled(F.regexp_extract(text, r"proto=(\w+)", 1))).alias("protocol"),
        number(F.regexp_extract(text, r"(?:bytes_sent|src_bytes)=(\d+)", 1)).alias("bytes_sent"),
        number(F.regexp_extract(text, r"(?:bytes_recv|dst_bytes)=(\d+)", 1)).alias("bytes_received"),
    )


# Codes of actions, actions of Windows event ids, and the words of system messages, in order.
ACTION_CODES = {"info": 0, "auth_attempt": 1, "auth_success": 2, "auth_fail": 3, "process_create": 4, "process_terminate": 5, "network_connect": 6, "network_deny": 7, "policy_change": 8, "privilege_use": 9, "data_access": 10, "config_change": 11}
ACTION_OF_WINDOWS = {4624: "auth_success", 4625: "auth_fail", 4634: "info", 4648: "auth_attempt", 4656: "data_access", 4663: "data_access", 4672: "privilege_use", 4688: "process_create", 4689: "process_terminate", 4697: "config_change", 4698: "config_change", 4720: "config_change", 4722: "config_change", 4724: "config_change", 4728: "policy_change", 4732: "policy_change", 4756: "policy_change", 4768: "auth_attempt", 4769: "auth_attempt", 4771: "auth_fail", 4776: "auth_attempt", 5140: "data_access", 7045: "config_change", 1102: "config_change", 4104: "process_create"}
ACTION_OF_VERB = {"get": "data_access", "list": "data_access", "watch": "data_access", "create": "config_change", "update": "config_change", "patch": "config_change", "delete": "config_change", "exec": "process_create", "attach": "process_create"}
ACTION_WORDS = (
    ("accepted|successful|opened", "auth_success"),
    ("failed|invalid|denied|rejected", "auth_fail"),
    ("session opened|logged in|login", "auth_attempt"),
    ("sudo|su:|root", "privilege_use"),
    ("started|exec|spawn|fork", "process_create"),
    ("stopped|killed|terminated|exit", "process_terminate"),
    ("connect|established|syn", "network_connect"),
    ("blocked|dropped|firewall", "network_deny"),
    ("changed|modified|updated|installed", "config_change"),
)
RISK_OF_WINDOWS = {4624: 0.1, 4625: 0.7, 4634: 0.05, 4648: 0.6, 4656: 0.4, 4663: 0.3, 4672: 0.5, 4688: 0.3, 4689: 0.1, 4697: 0.8, 4698: 0.7, 4720: 0.9, 4722: 0.7, 4724: 0.6, 4728: 0.8, 4732: 0.8, 4756: 0.7, 4768: 0.2, 4769: 0.2, 4771: 0.6, 4776: 0.3, 5140: 0.4, 5145: 0.4, 7045: 0.8, 1102: 0.9, 4104: 0.6}
RISK_OF_LEVEL = {"debug": 0.0, "info": 0.05, "warning": 0.3, "error": 0.5, "critical": 0.8}
ADMIN_EVENTS = (4672, 4720, 4728, 4732, 4756, 7045, 1102)
SEVERITY_OF_WORD = {"debug": 0, "info": 0, "notice": 1, "warning": 2, "warn": 2, "error": 3, "err": 3, "critical": 4, "alert": 4, "emergency": 4, "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "low": 1, "medium": 2, "high": 3}
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1, "igmp": 2, "gre": 47, "esp": 50, "ah": 51, "sctp": 132}
SERVICES = {22: "ssh", 53: "dns", 80: "http", 443: "https", 445: "smb", 3389: "rdp", 161: "snmp", 25: "smtp", 21: "ftp", 23: "telnet"}
SOURCE_TYPES = {"syslog": 1, "sshd": 1, "sudo": 1, "journald": 1, "windows_event": 2, "sysmon": 2, "firewall": 3, "active_directory": 4, "dns": 5, "cloudtrail": 6, "kubernetes": 7, "nginx": 8, "apache": 8, "netflow": 9, "zeek": 10, "suricata": 10}


def classify_action(text: Column, topic: Column, event_id: Column, verb: Column, cloud: Column) -> Column:
    """One of 12 action codes (B17): by Windows event id, cluster verb, cloud action, network topic, then words."""
    low, cloud_low = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(cloud, F.lit("")))
    by_name = lambda name: F.lit(ACTION_CODES[name])
    has = lambda c, *words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    windows = lookup({k: ACTION_CODES[v] for k, v in ACTION_OF_WINDOWS.items()}, event_id)
    verbs = F.coalesce(lookup({k: ACTION_CODES[v] for k, v in ACTION_OF_VERB.items()}, F.lower(verb)), by_name("info"))
    clouds = first_match([
        (has(cloud_low, "create", "put", "attach", "add", "delete", "remove", "detach"), by_name("config_change")),
        (has(cloud_low, "get", "describe", "list", "head"), by_name("data_access")),
        (has(cloud_low, "login", "signin"), by_name("auth_attempt")),
    ], by_name("info"))
    network = F.when(has(low, "deny", "block", "drop"), by_name("network_deny")).otherwise(by_name("network_connect"))
    words = first_match([(matches(text, rf"\b(?:{w})\b"), by_name(name)) for w, name in ACTION_WORDS], by_name("info"))
    return first_match([(windows.isNotNull(), windows), (F.coalesce(verb != "", F.lit(False)), verbs), (cloud_low != "", clouds), (topic == "network-events", network)], words)


def admin_action(text: Column, event_id: Column, logon_type: Column, groups: Column, cloud: Column) -> Column:
    """Whether an event is an administrative action."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cloud_low = F.lower(F.coalesce(cloud, F.lit("")))
    words = F.slice(F.split(F.trim(low), r"\s+"), 1, 3)
    signs = [logon_type == 10, event_id.isin(*ADMIN_EVENTS), F.contains(groups, F.lit("system:masters")), cloud_low.rlike("iam|policy|role|permission|createuser"), F.contains(low, F.lit("sudo")), F.array_contains(words, "root")]
    return reduce(lambda a, b: a | b, [F.coalesce(s, F.lit(False)) for s in signs])


def event_risk(event_id: Column, cef_severity: Column, level: Column) -> Column:
    """Risk from 0 to 1 by event id, else by CEF severity, else by level."""
    return F.coalesce(lookup(RISK_OF_WINDOWS, event_id), F.when(cef_severity.isNotNull(), F.least(cef_severity / 10, F.lit(1.0))), lookup(RISK_OF_LEVEL, F.lower(level)), F.lit(0.1))


def map_severity(word: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_OF_WORD, F.lower(word)), F.lit(0))


def map_protocol(name: Column) -> Column:
    return F.coalesce(lookup(PROTOCOL_NUMBERS, F.lower(name)), F.lit(0))


def map_source_type(name: Column) -> Column:
    return F.coalesce(lookup(SOURCE_TYPES, F.lower(name)), F.lit(1))


def port_to_service(port: Column) -> Column:
    return F.coalesce(lookup(SERVICES, port), F.concat(F.lit("port_"), port))


#: Words for harmless rows in labelled data sets.
BENIGN_WORDS = ("", "0", "normal", "benign", "background", "none", "legitimate", "-")


def normalize_labels(label: Column, attack: Column | None = None) -> Column:
    """Struct of label (0 or 1) and attack_type from the wordings of data sets."""
    low = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    bad = ~low.isin(*BENIGN_WORDS)
    name = F.coalesce(attack, low) if attack is not None else low
    return F.struct(bad.cast("int").alias("label"), F.when(bad, F.lower(name)).otherwise("normal").alias("attack_type"))


def search_events(df: DataFrame, text: str, fields: list[str], ts: str, key: str, min_severity: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest events that hold a text in one of ``fields``, without regard to case, a page of them.

    The key breaks ties of time, so that pages do not overlap.
    """
    found = df.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower())))
    if min_severity is not None:
        found = found.filter(F.col("severity") >= min_severity)
    return found.orderBy(F.desc(ts), F.desc(key)).offset(offset).limit(limit)


def search_count(df: DataFrame, text: str, fields: list[str]) -> DataFrame:
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower()))).agg(F.count("*").alias("total"))
