"""Case graphs and reports: what a bare case has, entities that cases share, sections by signals, action templates."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import cases


@pytest.fixture(scope="module")
def two(spark):
    """One case with every signal and null fields; one with nothing but its id."""
    rich = spark.range(1).selectExpr(
        "7L AS event_id", "'h1' AS host", "'10.0.0.1' AS src_ip", "cast(null as string) AS usr", "'a [b] \"c\"' AS message", "'sshd' AS source", "0.5D AS score", "0.9D AS case_score", "'CONFIRMED_ATTACK' AS finding_type",
        "transform(sequence(1, 7), i -> named_struct('name', concat('r', i), 'severity', i % 4 + 1)) AS rules", "4.25D AS z", "true AS is_anomaly", "3L AS destinations", "2L AS hops", "1 AS ioc_neighbor", "0.5D AS lateral", "0.05D AS c2",
        "9L AS escalations", "transform(sequence(1, 9), i -> concat('a', i)) AS related", "2L AS similar", "0.25D AS nearest", "array('impact', null, '', 'execution', 'impact', 'zzz') AS tactics", "'c1' AS campaign_id", "array('h2', 'h1') AS campaign_hosts",
        "true AS verified", "false AS intact", "array('b1') AS batches", "array(named_struct('value', '9.9.9.9', 'kind', 'ip')) AS matches", "3L AS false_positives", "1L AS true_positives", "'true_positive' AS verdict", "'P1' AS priority",
    )
    return rich.unionByName(spark.range(1).selectExpr("8L AS event_id", "'h2' AS host"), allowMissingColumns=True)


def test_graphs(two):
    graphs = cases.case_graphs(two, verified=True)
    assert {r.event_id: (r.signals, r.density) for r in graphs.collect()} == {7: (7, "rich"), 8: (0, "sparse")}
    nodes, edges = {}, {}
    for r in cases.graph_nodes(graphs).collect():
        nodes.setdefault(r.event_id, {})[r.id] = (r.kind, r.label, r.status)
    for r in cases.graph_edges(graphs).collect():
        edges.setdefault(r.event_id, set()).add((r.source, r.target, r.kind))
    assert {i for i in nodes[8] if not i.startswith("check")} == {"host:h2", "finding:8", "verdict:8"}
    assert nodes[7]["check:evidence:7"] == ("check", "1 batches", "fail")
    assert nodes[7]["check:false positives:7"][2] == "fail"
    assert nodes[7]["check:indicators:7"][2] == "pass"
    assert nodes[8]["check:indicators:8"][2] == "neutral"
    assert [i for i in nodes[7] if i.startswith("rule:")] == [f"rule:r{i}" for i in range(1, 6)]
    assert sum(i.startswith("alert:") for i in nodes[7]) == 6
    assert "c2:7" not in nodes[7]
    assert "user:" not in nodes[7]
    chain = {(a, b) for a, b, kind in edges[7] if kind in ("begins", "progresses")}
    assert chain == {("host:h1", "tactic:execution"), ("tactic:execution", "tactic:impact"), ("tactic:impact", "tactic:zzz")}
    assert all(a in nodes[k] and b in nodes[k] for k in edges for a, b, _ in edges[k])
    assert {r.event_id for r in cases.graph_nodes(graphs).filter("kind in ('check', 'verdict') or id like '%h2'").collect()} == {7, 8}


def test_cases_meet_in_entities(two):
    nodes, edges = cases.merged_graph(cases.case_graphs(two))
    assert {r.id: r.cases for r in nodes.collect()}["host:h2"] == 2
    assert {(r.source, r.target): r.cases for r in edges.collect()}[("campaign:c1", "host:h2")] == 1
    assert cases.merged_graph(cases.case_graphs(two.filter("false")))[0].count() == 0


def test_diagrams(two):
    text = {r.event_id: r.diagram for r in cases.graph_diagram(cases.case_graphs(two.withColumn("finding_type", F.lit('odd "x" | [y]')))).collect()}
    assert text[8].splitlines() == ["flowchart LR", '  n1["host h2"]', '  n2["finding odd x  y"]', "  n1 -->|found| n2"]
    assert text[7].count("-->") > 15


def test_reports(two):
    lines = {}
    for r in cases.report_lines(two, verified=True).orderBy("event_id", "place").collect():
        lines.setdefault(r.event_id, []).append((r.section, r.line))
    fired = [x for s, x in lines[7] if s == "fired"]
    assert fired[0] == "rules: 7 rules: r1, r2, r3, r4, r5"
    assert fired[3] == "history: 9 escalations, related a1, a2, a3, a4, a5, a6 and 3 more"
    assert len(fired) == 7
    assert [s for s, _ in lines[8]] == ["subject", "trigger", *["not fired"] * 7, "finding", "evidence", "indicators", "timeline", "false positives", "verdict"]
    assert ("kill chain", "execution > impact > zzz") in lines[7]
    assert ("kill chain", "3 phases: advanced persistent threat") in lines[7]
    assert ("evidence", "warning: logs may have been changed between collection and analysis") in lines[7]
    assert ("false positives", "high: similar alerts are mostly false") in lines[7]
    assert lines[7][-1][1].endswith("IMMEDIATE: Isolate h1 (10.0.0.1), revoke active sessions, engage IR team. Tactics: execution, impact, zzz.")
    texts = {r.event_id: r.report for r in cases.report_texts(cases.report_lines(two)).collect()}
    assert texts[8].startswith("subject: h2 | n/a | n/a")
    assert len(texts[8].splitlines()) == 10


def test_actions(spark):
    rows = [("true_positive", "P2", None, "", "F", None), ("inconclusive", "P1", "h", "s", None, ["a"]), ("false_positive", None, "h", "s", "f", []), (None, None, "h", "s", "f", [])]
    df = spark.createDataFrame(rows, "v string, p string, h string, s string, f string, t array<string>")
    got = [r[0] for r in df.select(cases.verdict_action(*(F.col(c) for c in "vphsft"))).collect()]
    assert got[0] == "INVESTIGATE: Review unknown (unknown) activity, check lateral movement, collect forensic artifacts. Finding: F."
    assert got[1] == "MONITOR: Increase monitoring for h (s). Collect additional context before escalation. Finding: ."
    assert got[2] == got[3] == "NO ACTION: Verified as false positive for h. Consider adding allowlist entry if recurring."
    other = spark.range(1).select(cases.finding_severity(F.lit("x")), cases.finding_action(F.lit(None).cast("string"))).first()
    assert tuple(other) == ("medium", "Investigate further.")
