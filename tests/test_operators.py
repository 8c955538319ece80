"""Decision tables, invariants and batch-stream equality on small frames."""

import hashlib
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from logloom.functions import normalize as N
from logloom.operators import detect, evidence, investigate, joins, rollups, windows, sweeps
from logloom.plans import registry
from logloom.sources import ingest

registry.load_all()
DATA = "/root/testdata/sf0.001"


def values(df, column):
    return [r[column] for r in df.collect()]


def test_levels(spark):
    df = spark.createDataFrame([("0",), ("3",), ("4",), ("6",), ("7",), ("emerg",), ("Err",), ("warn",), ("trace",), ("x",), (None,)], "level string")
    assert values(df.select(N.normalize_level(F.col("level")).alias("l")), "l") == ["CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG", "CRITICAL", "ERROR", "WARNING", "DEBUG", "INFO", "INFO"]


def test_labels_win_over_text(spark):
    df = spark.createDataFrame([("Failed password", "DoS"), ("Failed password", "benign"), ("hello", None)], "text string, label string")
    out = df.select(N.classify_event(F.col("text"), F.lit("INFO"), F.col("label")).alias("c")).select("c.*").collect()
    assert [(r.event_type, r.category) for r in out] == [("security", "dos"), ("security", "auth"), ("raw", None)]


def test_deterministic_ids_are_uuid_v5(spark):
    df = spark.createDataFrame([(3, 17), (0, 0)], "p int, o long")
    got = values(df.select(ingest.deterministic_event_id(F.lit("raw-logs"), F.col("p"), F.col("o")).alias("u")), "u")
    assert got == [str(uuid.uuid5(uuid.UUID(ingest.NAMESPACE), f"raw-logs:{p}:{o}")) for p, o in ((3, 17), (0, 0))]


def test_merkle_root_by_hand_and_tamper(spark):
    def root(leaves):
        level = list(leaves)
        while len(level) & (len(level) - 1) or len(level) == 1:
            level.append(level[-1])
        while len(level) > 1:
            level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
        return level[0]

    leaves = [(b, i, hashlib.sha256(f"{b}-{i}".encode()).hexdigest().upper()) for b, n in ((1, 1), (2, 2), (3, 5), (4, 8)) for i in range(n)]
    df = spark.createDataFrame(leaves, "batch long, event_id long, leaf string")
    got = {r.batch: (r.merkle_root, r.leaf_count) for r in evidence.merkle_roots(df, "batch", ["event_id"]).collect()}
    for b, n in ((1, 1), (2, 2), (3, 5), (4, 8)):
        assert got[b] == (root([x[2] for x in leaves if x[0] == b]), n)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_merkle_subtrees_of_any_height(spark, monkeypatch, levels):
    """Trees of several subtrees, the last ones partly or wholly padding, have the roots of a fold level by level."""
    monkeypatch.setattr(evidence, "SUBTREE_LEVELS", levels)

    def root(level):
        level = level + level[-1:] * ((1 << max(1, (len(level) - 1).bit_length())) - len(level))
        while len(level) > 1:
            level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
        return level[0]

    sizes = (1, 2, 3, 5, 9, 15, 16) if levels < 10 else (1, 1024, 1025, 2100)
    leaves = [(n, i, f"{n}-{i}") for n in sizes for i in range(n)]
    df = spark.createDataFrame(leaves, "batch long, event_id long, leaf string")
    got = {r.batch: (r.merkle_root, r.leaf_count) for r in evidence.merkle_roots(df, "batch", ["event_id"]).collect()}
    assert got == {n: (root([f"{n}-{i}" for i in range(n)]), n) for n in sizes}


def test_running_totals_are_trailing_counts(spark):
    """Rows and distinct values in the trailing span against brute force, with ties, nulls, gaps and hot values."""
    draw = random.Random(3)
    facts = [(draw.choice(["x", "x", "x", "y"]), draw.randrange(2000), draw.choice(["a", "a", "b", "c", None])) for _ in range(120)]
    left = [(i, draw.choice(["x", "y", "z"]), draw.choice([0, 100, *[u for _, u, _ in facts], *[u + 50 for _, u, _ in facts], *[u + 51 for _, u, _ in facts]])) for i in range(150)]
    f = spark.createDataFrame(facts, "key string, us long, value string")
    a = spark.createDataFrame(left, "event_id int, key string, us long")
    changes = [sweeps.occurrences(f, "key", "us", 50, "n"), sweeps.appearances(f, "key", "value", "us", 50, "distinct")]
    got = {r.event_id: (r.n, r.distinct) for r in sweeps.running_totals(a, "key", "us", changes, 50).collect()}
    near = lambda k, u: [v for key, t, v in facts if key == k and u - 50 <= t <= u]
    assert got == {i: (len(near(k, u)), len({v for v in near(k, u) if v})) for i, k, u in left}
    assert sweeps.running_totals(a.filter("false"), "key", "us", changes, 50).count() == 0


def test_leaf_layouts_and_empty_batches(spark):
    row = {"event_id": "e1", "timestamp": "2024-01-01 00:00:00", "hostname": "h", "pid": 7, "ppid": None, "binary_path": "/bin/x", "arguments": "-a"}
    df = spark.createDataFrame([tuple(row.values())], "event_id string, timestamp string, hostname string, pid int, ppid int, binary_path string, arguments string")
    want = hashlib.sha256(b"e12024-01-01 00:00:00h7/bin/x-a").hexdigest().upper()
    leaves = evidence.leaf_hashes(df, "process_events")
    assert values(leaves, "leaf") == [want]
    batches = spark.createDataFrame([(0,), (1,)], "batch long")
    got = {r.batch: (r.merkle_root, r.leaf_count, r.depth) for r in evidence.merkle_roots(leaves.withColumn("batch", F.lit(0).cast("long")), "batch", ["event_id"], batches=batches).collect()}
    assert got[1] == (hashlib.sha256(b"EMPTY_BATCH").hexdigest(), 0, 0) and got[0][1:] == (1, 1)


def test_interval_join_is_the_range_join(spark):
    a = spark.createDataFrame([(1, "x", 100), (2, "x", 250), (3, "y", 100), (4, None, 5)], "event_id int, key string, us long")
    b = spark.createDataFrame([("x", 0), ("x", 100), ("x", 149), ("x", 251), ("y", 99), (None, 5)], "key string, at long")
    got = sorted((r.event_id, r["at"]) for r in joins.interval_join(a, b, ["key"], "us", "at", 100).collect())
    want = sorted((i, t) for i, k, u in ((1, "x", 100), (2, "x", 250), (3, "y", 100)) for l, t in (("x", 0), ("x", 100), ("x", 149), ("x", 251), ("y", 99)) if k == l and u - 100 <= t <= u)
    assert got == want


def test_partial_rollups_merge_to_the_whole(spark):
    rows = [(i % 3, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, n long")
    part = lambda d: d.groupBy("k").agg(F.sum("n").alias("n"), F.min("n").alias("low"))
    merged = rollups.merge_rollup(part(df.filter("n < 20")), part(df.filter("n >= 20")), ["k"], sums=["n"], mins=["low"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, part(df).collect()))


def test_route_branches(spark):
    df = spark.createDataFrame([(0.96, 0.0, False), (0.96, 0.0, True), (0.8, 0.35, False), (0.8, 0.1, False), (0.5, 0.35, False), (0.1, 0.5, False)], "a double, s double, ok boolean")
    route = detect.route_score(F.col("a"), F.col("s"), F.lit(0.39), F.lit(0.95), F.col("ok"))
    assert values(df.select(route.alias("r")), "r") == ["escalate", "discard", "escalate", "monitor", "monitor", "discard"]


def test_templates_add_up_and_ignore_order(spark):
    rows = [(f"login of user{i} failed after {i * 100000} ms",) for i in range(5)] * 3 + [("disk full on /var/log/x",)] * 4 + [(None,), ("",)]
    df = spark.createDataFrame(rows, "message string")
    one = detect.mine_templates(df)
    assert one.agg(F.sum("n")).first()[0] == len(rows)
    two = detect.mine_templates(df.orderBy(F.rand(3)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_kill_chain_stages(spark):
    rows = [(1, "h", 0, 1, 0.9), (2, "h", 10, 3, 0.1), (3, "h", 20, 3, 0.9), (4, "h", 30, 2, 0.9), (5, "h", 4000, 0, 0.9)]
    df = spark.createDataFrame([(e, h, t * 1_000_000, s, x) for e, h, t, s, x in rows], "event_id long, host string, us long, step int, score double")
    out = windows.kill_chain(df, "host", "step").orderBy("event_id")
    assert values(out, "chain_stage") == [1, 1, 3, 3, 0]


def test_streams_match_their_batch_twins(spark):
    for stream, batch, columns in (("j4_ewma_stream", "f9_ewma_rates", ["event_id", "rate_fast", "error_rate"]), ("j5_kill_chain_stream", "g5_kill_chain", ["event_id", "chain_stage"])):
        a, b = (sorted(map(tuple, registry.QUERIES[n](spark, DATA).select(*columns).collect())) for n in (stream, batch))
        assert a == b


def test_replayed_batches_leave_no_rows_twice(spark, tmp_path):
    df = spark.sql("SELECT 'raw' AS event_type, timestamp_ntz'2024-01-01 00:00:00' AS ts, 1 AS x")
    for _ in range(2):
        ingest.append_sink(df, 7, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 1


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dur,sbytes,dbytes,attack_cat\n1.5,10,20,Fuzzers\n2,x,1,Normal\n")
    rows = ingest.read_csv_dataset(spark, f"file://{tmp_path}/a.csv", "network_attacks").orderBy("duration").collect()
    assert [(r.label, r.attack_type, r.bytes_out) for r in rows] == [(1, "fuzzers", 10.0), (0, "normal", None)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "host string, n int")
    for fmt in ("csv", "json", "markdown"):
        ingest.export_report(df, fmt, f"file://{tmp_path}/{fmt}", f"file://{tmp_path}/history")
    assert spark.read.text(f"file://{tmp_path}/markdown").first()[0] == "| a | 1 |"
    assert spark.read.parquet(f"file://{tmp_path}/history").count() == 3


def test_folds_carry_state_over_batches(spark):
    """A key's history is never one frame: results are the same when its rows come in many batches."""
    rows = [(i, ("a", "b", None)[i % 3], i * 40_000_000, (i * 7 % 10) / 10, i % 5, i % 6, f"t{i % 4}") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, host string, us long, score double, severity int, step int, event_type string")
    folds = [lambda: windows.ewma_rates(df, "host"), lambda: windows.kill_chain(df, "host", "step"), lambda: windows.alert_gate(df, ["host"])]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for fold in folds:
        whole = sorted(map(tuple, fold().collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            out = fold()
            assert sorted(map(tuple, out.collect())) == whole and whole
            assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_streams_of_many_files_lose_no_rows(spark):
    """Thousands of files, the newest rows first: none is late."""
    from logloom.plans import stream_plans
    from logloom.streaming import streams

    n = 2200
    rows = spark.range(0, n, 1, n).select(F.timestamp_micros((n - 1 - F.col("id")) * 60_000_000).alias("at"), F.lit("s").alias("source"))
    out = stream_plans.streamed(spark, rows, lambda s: streams.tumbling_counts(s, "at", ["source"], "1 hour")).agg(F.sum("events")).first()[0]
    assert out == (n - 1 - 10) // 60 * 60


def test_feature_rows_have_their_names_and_real_values(spark):
    """The rows of 19 and 32 features in order; parts with queries of their own agree with these; none is a constant that
    the data should move."""
    run = lambda name: {r.event_id: r for r in registry.QUERIES[name](spark, DATA).collect()}
    assert registry.QUERIES["g1_features_v6"](spark, DATA).columns == ["event_id", *detect.FEATURES_V6] and len(detect.FEATURES_V6) == 19
    rows = run("g2_features_v7")
    assert len(detect.FEATURES_V7) == 32 and list(next(iter(rows.values())).asDict()) == ["event_id", *detect.FEATURES_V7]
    for query, column, feature in (("b17_classify_action", "action_code", "action_type"), ("b18_admin_action", "admin", "is_admin_action"), ("b19_event_risk", "risk", "event_id_risk_score"), ("c2_char_entropy", "entropy", "message_entropy"), ("f11_baseline_z", "z", "host_score_baseline_z"), ("c4_keyword_threat", "threat", "keyword_threat_score")):
        part = run(query)
        assert part.keys() == rows.keys()
        assert all(abs(float(part[i][column]) - float(r[feature])) < 1e-5 for i, r in rows.items()), feature
    moved = {f for f in detect.FEATURES_V7 if len({r[f] for r in rows.values()}) > 1}
    assert {"has_known_ioc", "port_entropy", "kill_chain_stage", "user_score_baseline_z", "entity_event_rate"} <= moved
    assert len(set(investigate.FEATURE_ORDER)) == 46 and set(investigate.WEIGHTS) <= set(investigate.FEATURE_ORDER)


def test_descending_sums_over_ranges(spark):
    rows = [(float(i * 37 % 1009), i % 5, 1) for i in range(1009)]
    got = rollups.descending_sums(spark.createDataFrame(rows, "s double, a long, b long"), "s", {"x": "a", "y": "b"}, ranges=7).collect()
    total = {s: (sum(a for t, a, _ in rows if t >= s), sum(b for t, _, b in rows if t >= s)) for s, _, _ in rows}
    assert {r.s: (r.x, r.y) for r in got} == total
    assert rollups.descending_sums(spark.createDataFrame([], "s double, a long"), "s", {"x": "a"}).count() == 0


def test_state_is_carried_over_timed_batches(spark, tmp_path):
    """Three files come as three micro-batches at an interval; the running baseline equals that of all rows at once."""
    from logloom.streaming import streams

    rows = [(i, "h", i * 1_000_000, (i * 7 % 10) / 10) for i in range(30)]
    schema = "event_id long, host string, us long, score double"
    source = f"file://{tmp_path}/in"
    spark.createDataFrame(rows[:10], schema).coalesce(1).write.mode("append").parquet(source)
    out = streams.baseline_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "host")
    running = streams.run_every(out, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", "200 milliseconds")
    try:
        running.processAllAvailable()
        for part in (rows[10:20], rows[20:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            running.processAllAvailable()
        assert sum(p["numInputRows"] > 0 for p in running.recentProgress) == 3
    finally:
        running.stop()
    got = {r.event_id: r.z for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    whole = windows.running_baseline_z(spark.createDataFrame(rows, schema), "host", ["us", "event_id"])
    want = {r.event_id: r.baseline_z for r in whole.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - z) < 1e-9 for i, z in want.items())


def test_wide_feature_rows_are_made_from_few_scans(spark):
    """The events are read once and each part once or twice from what that wrote; a part is not worked out anew for the next
    (the plan scanned the events 200 times before)."""
    plan = registry.QUERIES["g2_features_v7"](spark, DATA)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "events.parquet" not in plan
    assert plan.count("FileScan") <= 20


def test_port_entropy_by_brute_force(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(("a", "b", None)), draw.randrange(50), draw.choice((22, 53, 80, 443, None))) for i in range(600)]
    got = {r.event_id: r.port_entropy for r in windows.port_entropy(spark.createDataFrame(rows, "event_id long, src_ip string, us long, dst_port int").repartition(5), "src_ip", ["us", "event_id"], rows=20).collect()}
    for source in ("a", "b", None):
        own = sorted((us, i, port) for i, s, us, port in rows if s == source)
        for at, (_, i, _) in enumerate(own):
            held = [p for _, _, p in own[max(0, at - 19) : at + 1] if p is not None]
            want = -sum(held.count(p) / len(held) * math.log2(held.count(p) / len(held)) for p in set(held))
            assert abs(got[i] - want) < 1e-9


def _history(seed, n=240):
    draw = random.Random(seed)
    return [(i, draw.choice(("h1", "h2", "h3", None)), draw.choice(("a", "b", "unknown", None)), draw.choice(("u", "v", None)), draw.choice((None, *[x * 900_000_000 for x in range(40)])), draw.choice(("s", "t", None)), draw.choice(("x", "y", "z", None)), draw.random()) for i in range(n)]


HISTORY = "event_id long, host string, src_ip string, usr string, us long, source string, tactic string, score double"


def test_campaigns_and_temporal_features_by_pairs(spark):
    """Against a loop over all pairs: equal times, times just at the span, missing keys, values and times, alerts that are no fact."""
    span = 3_600_000_000
    for seed in (1, 2):
        rows = _history(seed)
        df = spark.createDataFrame(rows, HISTORY).repartition(3)
        near = lambda a, f: a[4] is not None and f[4] is not None and a[4] - span <= f[4] <= a[4]
        got = {r.event_id: (r.hosts, r.tactics, r.host_list) for r in investigate.campaigns(df, df, hours=1, least=0.5, most_hosts=2).collect()}
        want = {}
        for a in rows:
            met = [f for f in rows if a[2] in ("a", "b") and f[2] == a[2] and near(a, f) and f[7] >= 0.5]
            if met:
                hosts = sorted({f[1] for f in met} - {None})
                want[a[0]] = (len(hosts), len({f[6] for f in met} - {None}), hosts[:2])
        assert got == want
        got = {r.event_id: (r.escalations, r.sources, r.tactics, round(r.mean_score, 9), r.related) for r in investigate.temporal_features(df, df, hours=1, related=4).collect()}
        assert got.keys() == {r[0] for r in rows}
        for a in rows:
            high = [f for f in rows if a[1] and f[1] == a[1] and near(a, f) and f[7] >= 0.39 and f[0] != a[0]]
            ip = [f for f in high if a[2] and f[2] == a[2]]
            both = sorted({(f[4], f[0]) for f in high if (a[2] and f[2] == a[2]) or (a[3] and f[3] == a[3])})[-4:]
            assert got[a[0]] == (len(ip), len({f[5] for f in ip} - {None}), len({f[6] for f in ip} - {None}), round(sum(f[7] for f in ip) / len(ip), 9) if ip else 0.0, sorted(i for _, i in both))


def test_look_backs_make_no_pairs(spark):
    """300 alerts of one entity at nearly one time: each met the rows before it in a join, before."""
    df = spark.createDataFrame([(i, "h", "a", "u", i, "s", "x", 0.9) for i in range(300)], HISTORY)
    for out in (investigate.campaigns(df, df), investigate.temporal_features(df, df)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "fact_us" not in text and "_right_at" not in text  # no interval join
