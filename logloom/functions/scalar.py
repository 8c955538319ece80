"""Scalar features as column expressions (inventory C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.normalize import first_match, lookup

# Words whose presence counts as a threat.
THREAT_WORDS = ("fail", "denied", "error", "attack", "exploit", "malicious", "unauthorized", "violation", "brute", "inject", "overflow", "escalat", "privilege", "sudo", "root", "admin", "backdoor", "payload", "malware", "shellcode", "reverse", "c2", "beacon", "exfiltrat", "lateral", "mimikatz", "phish", "trojan", "ransomware", "keylog", "credential", "dump", "powershell", "encoded", "obfuscat")
SEVERITY_WEIGHTS = {4: 25, 3: 10, 2: 4, 1: 1}
# Masks of a message's variable parts, in order.
MASKS = (
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "<IP>"),
    (r"(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(([0-9a-fA-F]{1,4}:){1,7}:)|(::([0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}))", "<IPV6>"),
    (r"([0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}", "<MAC>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<TIMESTAMP>"),
    (r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"(?<=[^A-Za-z0-9])0x[0-9a-fA-F]{8,}(?=[^A-Za-z0-9]|$)", "<HEX>"),
    (r"(?<=[^A-Za-z0-9\.])\d{5,}(?=[^A-Za-z0-9\.:]|$)", "<NUM>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"(/[A-Za-z0-9_\-\.]+){3,}", "<PATH>"),
    (r"(?<=:)\d{2,5}(?=[^0-9]|$)", "<PORT>"),
)


def temporal_features(ts: Column) -> Column:
    """Struct of hour, weekday (Monday 0) and off_hours: before 6, from 22, or at the weekend."""
    hour, day = F.hour(ts), F.weekday(ts)
    return F.struct(hour.alias("hour"), day.alias("weekday"), ((hour < 6) | (hour >= 22) | (day >= 5)).cast("int").alias("off_hours"))


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for null and empty texts."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    held = F.aggregate(counts, F.lit(0.0), lambda total, m: total + m * F.log2(m))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.log2(n) - held / n, F.lit(0.0)))


def text_stats(text: Column) -> Column:
    """Struct of log10(1 + length), share of digits and share of other than letters, digits and white space."""
    safe = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(safe), F.lit(1))
    return F.struct(F.log10(F.length(safe) + 1).alias("length_log"), (F.length(F.regexp_replace(safe, r"[^0-9]", "")) / n).alias("digit_ratio"), (F.length(F.regexp_replace(safe, r"[A-Za-z0-9\s]", "")) / n).alias("special_ratio"))


def keyword_threat_score(text: Column) -> Column:
    """ln(1 + hits) / ln(1 + words) over the threat words (C4)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in THREAT_WORDS])
    return F.log1p(hits) / F.log1p(F.lit(len(THREAT_WORDS)))


def byte_features(sent: Column, received: Column) -> Column:
    """Struct of clamped bytes, their ratio and the logarithm of their sum."""
    clamp = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0)).cast("double"), F.lit(0.0)), F.lit(1e9))
    a, b = clamp(sent), clamp(received)
    return F.struct(a.alias("sent"), b.alias("received"), F.when(a + b > 0, a / (a + b)).otherwise(0.0).alias("ratio"), F.log10(1 + a + b).alias("total_log"))


def event_freq_1m(duration_s: Column) -> Column:
    return F.when(duration_s > 0, 60.0 / duration_s).otherwise(0.0)


def connection_error_type(text: Column, total_bytes: Column, duration_ms: Column) -> Column:
    """syn_error, reject_error or none, by words, or by a connection without bytes and duration."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_match([(low.rlike("syn"), F.lit("syn_error")), (low.rlike("rst|reject|drop"), F.lit("reject_error")), ((total_bytes == 0) & (duration_ms < 1), F.lit("syn_error"))], F.lit("none"))


def sanitize(x: Column) -> Column:
    """NaN and null as 0, infinities as +-1e9."""
    return F.when(x == float("inf"), 1e9).when(x == float("-inf"), -1e9).otherwise(F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))


def z_scale(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.when(std < 1e-8, 1.0).otherwise(std)


def sigmoid_calibrate(raw: Column, mean: float, std: float, flip: bool = False) -> Column:
    p = 1 / (1 + F.exp((raw - mean) / (std if abs(std) > 1e-8 else 1.0)))
    return 1 - p if flip else p


def like_match(value: Column, pattern: Column) -> Column:
    """SQL LIKE without regard to case, with the pattern in a column (C11)."""
    return F.ilike(value, pattern)


def score_bucket(score: Column) -> Column:
    return (F.floor(score * 100 / 10) * 10).cast("int")


def severity_weight(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_WEIGHTS, severity), F.lit(0))


def classify_score(score: Column) -> Column:
    """Struct of the class of a score and the confidence in being on its side of one half (C14)."""
    name = first_match([(score >= 0.95, F.lit("critical")), (score >= 0.85, F.lit("high")), (score >= 0.70, F.lit("medium")), (score >= 0.50, F.lit("low"))], F.lit("info"))
    return F.struct(name.alias("label"), F.when(score >= 0.5, score).otherwise(1 - score).alias("confidence"))


#: What to do about a finding.
ACTIONS = {"critical": "isolate host and open incident", "high": "investigate at once", "medium": "review within a day", "low": "watch", "info": "none"}


def recommended_action(label: Column, host: Column) -> Column:
    return F.format_string("%s: %s", host, F.coalesce(lookup(ACTIONS, label), F.lit("none")))


def narrative(**sections: Column) -> Column:
    """Text of the sections that are not null, one line each."""
    return F.concat_ws("\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in sections.items()])


def parse_attributions(json: Column, n: int = 5) -> Column:
    """Feature attributions from an object or from an array of objects, the first ``n`` (C17)."""
    entry = "array<struct<feature:string,value:double>>"
    from_array = F.from_json(json, entry)
    from_object = F.transform(F.map_entries(F.from_json(json, "map<string,double>")), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("value")))
    return F.slice(F.when(F.ltrim(json).startswith("["), from_array).otherwise(from_object), 1, n)


def embedding_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def model_freshness(trained: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, trained)
    return first_match([(days <= 7, F.lit("fresh")), (days <= 30, F.lit("acceptable")), (days <= 90, F.lit("stale"))], F.lit("outdated"))


def mask_tokens(text: Column) -> Column:
    """A message with its variable parts masked (C20)."""
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text
