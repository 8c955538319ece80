"""Evidence chains and verification (inventory I)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.normalize import first_match
from logloom.operators.joins import anchor_cover, interval_join, small
from logloom.operators.scratch import written
from logloom.operators.sweeps import occurrences, running_totals

# The text whose hash is the root of a batch without leaves.
EMPTY_BATCH = "EMPTY_BATCH"
# The columns whose texts make a row's leaf, by table.
LEAF_COLUMNS = {
    "raw_logs": ("event_id", "timestamp", "source", "level", "message"),
    "security_events": ("event_id", "timestamp", "severity", "category", "source", "description", "mitre_tactic", "mitre_technique"),
    "process_events": ("event_id", "timestamp", "hostname", "pid", "ppid", "binary_path", "arguments"),
    "network_events": ("event_id", "timestamp", "hostname", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"),
    "triage_scores": ("event_id", "timestamp", "source_type", "hostname", "adjusted_score", "action", "mitre_tactic", "mitre_technique"),
    "hunter_investigations": ("investigation_id", "started_at", "hostname", "source_ip", "severity", "finding_type", "summary"),
    "verifier_results": ("verification_id", "started_at", "verdict", "confidence", "priority", "analyst_summary"),
}
#: Levels of a tree that are folded in one grouping (2^10 nodes of 64 bytes), and groupings above the first: 2^40 leaves.
SUBTREE_LEVELS, HIGHER_ROUNDS = 10, 3
#: Leaves that a task numbers.
NUMBERED_ROWS = 2_000_000
#: Leaves at either end of a batch that its anchor keeps.
KEPT_LEAVES = 100
# Kinds of findings for verdicts.
NEGATIVE = ("NORMAL_BEHAVIOUR", "FALSE_POSITIVE")
DEFINITE = ("CONFIRMED_ATTACK", "ACTIVE_CAMPAIGN")
AMBIGUOUS = ("BEHAVIOURAL_ANOMALY", "ANOMALOUS_PATTERN")


def leaf_hashes(df: DataFrame, parts: list[str] | str) -> DataFrame:
    """``df`` with ``leaf``: upper-case hex SHA-256 of the parts' texts, one after the other.

    ``parts`` are columns, or the name of a table of ``LEAF_COLUMNS``; nulls are empty texts.
    """
    columns = LEAF_COLUMNS[parts] if isinstance(parts, str) else parts
    return df.withColumn("leaf", F.upper(F.sha2(F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in columns]), 256)))


def time_batches(df: DataFrame, us: str = "us", seconds: int = 1800) -> DataFrame:
    """``df`` with ``batch``, windows of fixed length from the whole second of the least time on."""
    start = df.agg(F.floor(F.min(us) / 1_000_000).alias("_start"))
    return df.crossJoin(F.broadcast(start)).withColumn("batch", F.floor((F.col(us) / 1_000_000 - F.col("_start")) / seconds).cast("long")).drop("_start")


def merkle_roots(leaves: DataFrame, batch: str, order: list[str], leaf: str = "leaf", batches: DataFrame | None = None) -> DataFrame:
    """(batch, merkle_root, leaf_count, depth) of every batch.

    ``batches`` may name batches besides those with leaves; such a one without leaves has a fixed root and depth 0.

    Leaves are numbered by ``numbered_leaves``. Nodes are lower-case SHA-256 of the two children's hex. A batch is padded with its last leaf to a power of two; a
    single leaf is hashed with itself. Subtrees of ``SUBTREE_LEVELS`` levels are folded within one grouping, so a few
    groupings serve batches of any size.
    """
    numbered = numbered_leaves(leaves, batch, order, leaf)
    sizes = leaves.groupBy(batch).agg(F.count("*").alias("leaf_count"))
    depth = F.greatest(F.lit(1), F.ceil(F.log2("leaf_count"))).cast("int")
    sizes = sizes.withColumn("depth", depth)
    placed = numbered.join(sizes, batch).select(batch, "depth", "leaf_count", F.col("pos").cast("long").alias("pos"), F.col(leaf).alias("node"))
    step = F.lit(SUBTREE_LEVELS)
    # the last leaf stands for the padding of its own subtree, and for whole subtrees of padding after it
    fold = lambda nodes, levels: F.aggregate(F.sequence(F.lit(1), levels), nodes, lambda acc, _: F.transform(F.sequence(F.lit(0), (F.size(acc) / 2).cast("int") - 1), lambda i: F.sha2(F.concat(F.get(acc, 2 * i), F.get(acc, 2 * i + 1)), 256)))
    height = F.least(F.col("depth"), step)
    group = placed.groupBy(batch, "depth", "leaf_count", F.shiftright("pos", SUBTREE_LEVELS).alias("up"))
    held = group.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("held")).withColumn("height", height)
    short = F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), F.col("height")).cast("int") - F.size("held")
    padded = F.concat("held", F.array_repeat(F.element_at("held", -1), short))
    nodes = held.select(batch, "depth", "leaf_count", "height", F.col("up").alias("pos"), F.element_at("held", -1).alias("_end"), padded.alias("padded"))
    nodes = nodes.select(batch, "depth", "leaf_count", "pos", "_end", F.get(fold(F.col("padded"), F.col("height")), 0).alias("node"))
    # subtrees of nothing but padding, which follow the one that holds the last leaf
    final = F.col("pos") == F.floor((F.col("leaf_count") - 1) / (1 << SUBTREE_LEVELS))
    more = F.pow(F.lit(2), F.greatest(F.col("depth") - step, F.lit(0))).cast("long") - 1
    padding = F.aggregate(F.sequence(F.lit(1), step), F.col("_end"), lambda acc, _: F.sha2(F.concat(acc, acc), 256))
    rest = nodes.filter(final & (F.col("pos") < more)).select(batch, "depth", "leaf_count", F.explode(F.sequence(F.col("pos") + 1, more)).alias("pos"), padding.alias("node"))
    nodes = nodes.drop("_end").unionByName(rest).withColumn("left", F.col("depth") - height)
    for _ in range(HIGHER_ROUNDS):
        group = nodes.groupBy(batch, "depth", "leaf_count", "left", F.shiftright("pos", SUBTREE_LEVELS).alias("up"))
        held = group.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("held"))
        height = F.least(F.col("left"), step)
        whole = F.when(F.col("left") > 0, F.get(fold(F.col("held"), height), 0)).otherwise(F.get("held", 0))
        nodes = held.select(batch, "depth", "leaf_count", (F.col("left") - height).alias("left"), F.col("up").alias("pos"), whole.alias("node"))
    roots = nodes.select(batch, F.col("node").alias("merkle_root"), "leaf_count", "depth")
    if batches is None:
        return roots
    empty = batches.select(batch).distinct().join(sizes, batch, "left_anti")
    return roots.unionByName(empty.select(batch, F.sha2(F.lit(EMPTY_BATCH).cast("binary"), 256).alias("merkle_root"), F.lit(0).cast("long").alias("leaf_count"), F.lit(0).alias("depth")))


def numbered_leaves(leaves: DataFrame, batch: str, order: list[str], leaf: str, rows: int = NUMBERED_ROWS) -> DataFrame:
    """(batch, leaf, pos): each batch's leaves, numbered from 0 in order.

    Leaves are ranged by batch and order into parts of about ``rows`` rows and written so; rows are numbered within a part
    of a batch, and the counts of the parts before are added. So a task holds a part, however large a batch is. A table of no
    more than one part is numbered at once. Equal keys of ``order`` are numbered in any order.
    """
    own = leaves.select(batch, *order, leaf)
    parts = -(-own.count() // rows)
    if parts <= 1:
        return own.select(batch, leaf, (F.row_number().over(Window.partitionBy(batch).orderBy(*order)) - 1).cast("long").alias("pos"))
    ranged = written(own.repartitionByRange(parts, batch, *order).withColumn("_part", F.spark_partition_id()), "leaves")
    counts = ranged.groupBy(batch, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(batch).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = ranged.join(small(counts.select(batch, "_part", before.alias("_before"))), [batch, "_part"])
    place = F.row_number().over(Window.partitionBy(batch, "_part").orderBy(*order)) - 1
    return met.select(batch, leaf, (place + F.col("_before")).alias("pos"))


def end_leaves(leaves: DataFrame, batch: str, order: str, leaf: str = "leaf", most: int = KEPT_LEAVES) -> DataFrame:
    """(batch, leaves): the first and last leaves of every batch in order, all of a batch of up to twice ``most``.

    Each end is cut down within tasks before the shuffle.
    """
    place = lambda by: F.row_number().over(Window.partitionBy(batch).orderBy(by))
    ends = [leaves.select(batch, order, leaf, place(by).alias("_place")).filter(F.col("_place") <= most).drop("_place") for by in (F.asc(order), F.desc(order))]
    rows = F.array_sort(F.collect_set(F.struct(order, leaf)))
    return ends[0].union(ends[1]).groupBy(batch).agg(F.transform(rows, lambda x: x[leaf]).alias("leaves"))


def chain_roots(anchors: DataFrame, table: str = "table_name", order: str = "batch", root: str = "merkle_root") -> DataFrame:
    """Anchors with ``chained``, the SHA-256 of the chained root before and the own root; the first is unchanged (I4).

    A chain is a sequence by nature: each table's anchors, a row for each batch, pass in order through one task, which
    holds the last root alone.
    """
    columns = anchors.columns
    names, roots = columns.index(table), columns.index(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, first = None, None, True
        for part in batches:
            chained = []
            for name, own in zip(part.column(names).to_pylist(), part.column(roots).to_pylist(), strict=True):
                if first or name != now:
                    now, last, first = name, own, False
                else:
                    last = None if last is None or own is None else hashlib.sha256((last + own).encode()).hexdigest()
                chained.append(last)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(chained, pa.string())], names=[*columns, "chained"])

    shape = ", ".join(f"`{n}` {t}" for n, t in [*anchors.dtypes, ("chained", "string")])
    return anchors.repartition(table).sortWithinPartitions(table, F.col(order).cast("long")).mapInArrow(run, shape)


def anchor_table(df: DataFrame, table_name: str, parts: list[str] | str, us: str = "us", key: str = "event_id", seconds: int = 1800) -> DataFrame:
    """One anchor for each time batch: range, root, chained root, and the previous one."""
    batched = leaf_hashes(time_batches(df, us, seconds), parts)
    ranges = batched.groupBy("batch").agg(F.min(us).alias("time_from"), F.max(us).alias("time_to"))
    roots = merkle_roots(batched.select("batch", key, "leaf"), "batch", [key]).join(ranges, "batch").withColumn("table_name", F.lit(table_name))
    chained = chain_roots(roots)
    before = F.lag("chained").over(Window.partitionBy("table_name").orderBy("batch"))
    return chained.withColumn("prev_root", F.coalesce(before, F.lit("")))


def verify_batches(anchors: DataFrame, df: DataFrame, parts: list[str] | str, us: str = "us", key: str = "event_id", seconds: int = 1800) -> DataFrame:
    """Status of every anchor against the rows as they are now: pass, count changed, tampered or missing."""
    batched = leaf_hashes(time_batches(df, us, seconds), parts)
    now = merkle_roots(batched.select("batch", key, "leaf"), "batch", [key]).select("batch", F.col("merkle_root").alias("now_root"), F.col("leaf_count").alias("now_count"))
    both = anchors.join(now, "batch", "full")
    status = first_match([
        (F.col("merkle_root").isNull(), F.lit("unanchored")),
        (F.col("now_root").isNull(), F.lit("missing")),
        (F.col("leaf_count") != F.col("now_count"), F.lit("count changed")),
        (F.col("merkle_root") != F.col("now_root"), F.lit("tampered")),
    ], F.lit("pass"))
    return both.select("batch", "leaf_count", "now_count", status.alias("status"))


def unanchored(df: DataFrame, anchors: DataFrame, us: str = "us") -> DataFrame:
    """Rows after the last anchored time."""
    last = anchors.agg(F.coalesce(F.max("time_to"), F.lit(-1)).alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(us) > F.col("_last")).drop("_last")


def evidence_check(alerts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Number of anchors over each alert's time and whether their chain is whole (I8)."""
    before = F.lag("chained").over(Window.partitionBy("table_name").orderBy("batch"))
    checked = anchors.withColumn("_ok", F.coalesce(F.col("prev_root") == before, F.col("prev_root") == "")).withColumn("anchor_id", F.col("batch"))
    met = anchor_cover(alerts.select("event_id", "us"), checked.select("anchor_id", "time_from", "time_to", "_ok")).groupBy("event_id").agg(F.count("*").alias("anchors"), F.min("_ok").alias("chain_intact"))
    out = alerts.select("event_id").join(met, "event_id", "left")
    return out.select("event_id", F.coalesce("anchors", F.lit(0)).alias("anchors"), F.coalesce("chain_intact", F.lit(True)).alias("chain_intact"), F.col("anchors").isNull().alias("coverage_gap"))


def ioc_check(alerts: DataFrame, net: DataFrame, ioc: DataFrame, hours: int = 72) -> DataFrame:
    """Whether an alert's address is an indicator, its flows to indicators and all its flows before it."""
    span = hours * 3_600_000_000
    values = small(ioc.select(F.col("value").alias("dst_ip"), F.lit(1).alias("_bad")).distinct())
    real = F.col("src_ip").isNotNull()
    facts = net.filter(real).select("src_ip", "us", "dst_ip")
    # running totals of what enters and leaves the span: no alert is paired with its flows
    changes = [occurrences(facts, "src_ip", "us", span, "flows"), occurrences(facts.join(values, "dst_ip", "left_semi"), "src_ip", "us", span, "bad_flows")]
    counts = running_totals(alerts.filter(real), "src_ip", "us", changes, span)
    own = alerts.join(values.select(F.col("dst_ip").alias("src_ip"), F.col("_bad").alias("_own")), "src_ip", "left")
    out = own.join(counts, "event_id", "left").select("event_id", F.col("_own").isNotNull().alias("own_match"), F.coalesce("flows", F.lit(0)).alias("flows"), F.coalesce("bad_flows", F.lit(0)).alias("bad_flows"))
    return out.withColumn("corroborated", F.col("own_match") | (F.col("bad_flows") > 0))


def timeline(alerts: DataFrame, sources: dict[str, tuple[DataFrame, int]], key: str, before_us: int = 86_400_000_000, after_us: int = 3_600_000_000) -> DataFrame:
    """Entries of several sources around each alert, each source capped to its newest, merged in time order."""
    parts = None
    for name, (facts, cap) in sources.items():
        near = interval_join(alerts.select("event_id", key, "us"), facts.select(key, F.col("us").alias("at_us"), F.col("event_id").alias("entry_id")), [key], "us", "at_us", before_us, after_us)
        place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("at_us"), F.desc("entry_id")))
        own = near.withColumn("_place", place).filter(F.col("_place") <= cap).select("event_id", "at_us", F.lit(name).alias("kind"), "entry_id")
        parts = own if parts is None else parts.unionByName(own)
    entries = F.array_sort(F.collect_list(F.struct("at_us", "kind", "entry_id")))
    return parts.groupBy("event_id").agg(entries.alias("timeline"), F.count("*").alias("entries"))


def fp_history(alerts: DataFrame, labels: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Feedback on an entity: counts with prior verdicts at half weight, and the confidence in a false alarm."""
    fb = labels.groupBy(key).agg(F.count_if(F.expr("label = 'false_positive'")).alias("fp"), F.count_if(F.expr("label = 'true_positive'")).alias("tp"))
    pv = verdicts.groupBy(key).agg((F.count_if(F.expr("verdict = 'false_positive'")) / 2).alias("vfp"), (F.count_if(F.expr("verdict = 'true_positive'")) / 2).alias("vtp"))
    out = alerts.join(fb, key, "left").join(pv, key, "left").fillna(0, ["fp", "tp", "vfp", "vtp"])
    fp, tp = F.col("fp") + F.col("vfp"), F.col("tp") + F.col("vtp")
    conf = fp / (fp + tp + 1) * (1 - tp / F.greatest(F.lit(1.0), tp + 1))
    return out.withColumn("fp_confidence", conf).withColumn("has_fp_history", F.col("fp_confidence") > 0.6)


def calibrate_confidence(base: Column, evidence: Column, ioc: Column, fp: Column, coherent: Column) -> Column:
    """Base confidence times a weighted sum of the checks, clipped."""
    factor = 0.40 + 0.20 * evidence + 0.20 * ioc + 0.10 * (1 - fp) + 0.10 * coherent
    return F.least(F.greatest(base * factor, F.lit(0.0)), F.lit(1.0))


def verdict(finding: Column, confidence: Column, verified: Column, intact: Column, gap: Column, corroborated: Column, fp_history: Column, fp_confidence: Column, coherent: Column) -> Column:
    """Struct of verdict, confidence, priority and status: an ordered decision matrix."""
    evidence = F.when(verified & intact, 1.0).when(gap & intact, 0.5).otherwise(0.0)
    weighed = calibrate_confidence(confidence, evidence, F.when(corroborated, 1.0).otherwise(0.0), fp_confidence, F.when(coherent, 1.0).otherwise(0.0))

    def out(name: str, conf, priority, status: str) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(name).alias("verdict"), as_col(conf).alias("confidence"), as_col(priority).alias("priority"), F.lit(status).alias("status"))

    definite, unsure = finding.isin(*DEFINITE), finding.isin(*AMBIGUOUS)
    first = F.when(((confidence >= 0.80) & corroborated) | (finding == "ACTIVE_CAMPAIGN"), "P1").otherwise("P2")
    return first_match([
        (finding.isin(*NEGATIVE), out("false_positive", F.greatest(F.lit(0.7), 1 - confidence), "P4", "false_positive")),
        (fp_history & ~definite, out("false_positive", fp_confidence, "P4", "false_positive")),
        (verified & ~intact, out("inconclusive", 0.5, "P2", "inconclusive")),
        (definite, out("true_positive", weighed, first, "verified")),
        (unsure & (confidence >= 0.60) & corroborated, out("true_positive", weighed, "P2", "verified")),
        (unsure & (confidence >= 0.60), out("inconclusive", weighed, "P3", "inconclusive")),
        (unsure, out("inconclusive", confidence * 0.8, "P3", "inconclusive")),
    ], out("inconclusive", confidence * 0.7, "P3", "inconclusive"))


def skip_negative(df: DataFrame, finding: str = "finding_type") -> DataFrame:
    return df.filter(~F.col(finding).isin(*NEGATIVE))


def verified_graph(nodes: Column, checks: dict[str, Column]) -> Column:
    """A graph's nodes plus one node for each check that was made."""
    extra = F.filter(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(f"check:{name}").alias("id"), F.lit("check").alias("kind"))) for name, c in checks.items()]), lambda x: x.isNotNull())
    return F.concat(nodes, extra)


def chain_listing(anchors: DataFrame, limit: int = 1000) -> DataFrame:
    return anchors.orderBy(F.desc("time_from"), "table_name").limit(limit)
