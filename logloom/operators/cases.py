"""Graphs and reports of investigations (inventory H13, I15, C15, C16).

A case is one row: an alert, what its investigation found and, once it was verified, the checks. Its graph is typed nodes and
edges whose ids are the same in every case that meets the same entity, so the graphs of all cases add up by grouping; its
report is sections of lines, of which only those appear whose signal fired. All of it is column expressions: a case takes no
join, and graphs of any number of cases are made in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.normalize import first_match
from logloom.operators.scratch import written

# Tactics along the kill chain.
TACTICS = (
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion",
    "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
)

# Severity and recommended action of a finding.
FINDINGS = {
    "CONFIRMED_ATTACK": ("critical", "Immediately isolate the affected host and revoke active sessions. Escalate to Incident Response and preserve forensic artefacts."),
    "ACTIVE_CAMPAIGN": ("critical", "Activate the coordinated-attack runbook. Isolate all hosts listed in correlated_events, block source IPs at the perimeter, and alert the SOC lead."),
    "BEHAVIOURAL_ANOMALY": ("high", "Investigate the anomalous behaviour on the host. Review recent user activity and correlate with HR records if applicable. Escalate if additional IOCs are discovered."),
    "SIGMA_MATCH": ("high", "Validate the Sigma rule match against raw logs. If confirmed, treat as BEHAVIOURAL_ANOMALY and escalate."),
    "ANOMALOUS_PATTERN": ("medium", "Monitor the entity for further anomalous activity over the next 2 hours. Create a low-priority tracking ticket."),
    "NORMAL_BEHAVIOUR": ("low", "No action required. Continue standard monitoring."),
    "FALSE_POSITIVE": ("low", "No action required.  Consider tuning the originating triage rule."),
}
OTHER_FINDING = ("medium", "Investigate further.")
# Recommended action of a verdict, by verdict and priority; {h} host, {s} source address, {f} finding, {t} tactics.
VERDICT_ACTIONS = (
    ("true_positive", "P1", "IMMEDIATE: Isolate {h} ({s}), revoke active sessions, engage IR team. Tactics: {t}."),
    ("true_positive", None, "INVESTIGATE: Review {h} ({s}) activity, check lateral movement, collect forensic artifacts. Finding: {f}."),
    ("inconclusive", None, "MONITOR: Increase monitoring for {h} ({s}). Collect additional context before escalation. Finding: {f}."),
    (None, None, "NO ACTION: Verified as false positive for {h}. Consider adding allowlist entry if recurring."),
)
# Words for severities 1 to 4.
SEVERITY_WORDS = ("low", "medium", "high", "critical")


def _lookup(values: dict, key: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in values.items() for x in p])[key], F.lit(other))


def finding_severity(finding: Column) -> Column:
    return _lookup({k: v[0] for k, v in FINDINGS.items()}, finding, OTHER_FINDING[0])


def finding_action(finding: Column) -> Column:
    return _lookup({k: v[1] for k, v in FINDINGS.items()}, finding, OTHER_FINDING[1])


def verdict_action(verdict: Column, priority: Column, host: Column, source: Column, finding: Column, tactics: Column) -> Column:
    """What to do about a verdict. Missing hosts and addresses are ``unknown``, no tactics ``N/A``, no finding empty."""
    or_else = lambda c, x: F.coalesce(F.nullif(c, F.lit("")), F.lit(x))
    fills = {"{h}": or_else(host, "unknown"), "{s}": or_else(source, "unknown"), "{f}": F.coalesce(finding, F.lit("")), "{t}": or_else(F.array_join(tactics, ", "), "N/A")}

    def filled(template: str) -> Column:
        parts = [template]
        for mark in fills:
            parts = [y for x in parts for y in (sum(([p, mark] for p in x.split(mark)), [])[:-1] if x not in fills else [x])]
        return F.concat(*[fills.get(p, F.lit(p)) for p in parts])

    rules = [(F.coalesce(verdict == v, F.lit(False)) & (F.lit(True) if p is None else F.coalesce(priority == p, F.lit(False))), filled(t)) for v, p, t in VERDICT_ACTIONS[:-1]]
    return first_match(rules, filled(VERDICT_ACTIONS[-1][2]))


def along_chain(tactics: Column) -> Column:
    """Distinct tactics in the order of the kill chain; others come last, by name. Nulls and empty ones go."""
    place = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TACTICS)), t), F.lit(0)), F.lit(len(TACTICS) + 1).cast("long"))
    real = F.array_distinct(F.filter(F.coalesce(tactics, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")))
    return F.transform(F.array_sort(F.transform(real, lambda t: F.struct(place(t).alias("p"), t.alias("t")))), lambda x: x["t"])


#: Columns of a case with what stands for a missing one. Rules are (name, severity), matches (value, kind).
CASE = {
    "host": "'unknown'", "src_ip": "''", "usr": "''", "message": "''", "source": "'unknown'", "score": "0.0D", "case_score": "0.0D", "finding_type": "''",
    "rules": "cast(array() as array<struct<name:string,severity:int>>)", "z": "0.0D", "is_anomaly": "false", "destinations": "0L", "hops": "0L", "ioc_neighbor": "0", "lateral": "0.0D", "c2": "0.0D",
    "escalations": "0L", "related": "cast(array() as array<string>)", "similar": "0L", "nearest": "1.0D", "tactics": "cast(array() as array<string>)", "campaign_id": "cast(null as string)", "campaign_hosts": "cast(array() as array<string>)",
    "verified": "false", "intact": "true", "batches": "cast(array() as array<string>)", "matches": "cast(array() as array<struct<value:string,kind:string>>)", "flows": "0L", "timeline_events": "0L", "coherent": "true",
    "false_positives": "0L", "true_positives": "0L", "verdict": "''", "priority": "''", "confidence": "0.0D",
}


def complete_cases(cases: DataFrame, key: str = "event_id") -> DataFrame:
    """``key`` and all columns of a case: nulls and columns that are not there get their defaults."""
    return cases.select(key, *[(F.coalesce(F.col(c), F.expr(v)) if c in cases.columns else F.expr(v)).alias(c) for c, v in CASE.items()])


def _signals() -> dict[str, Column]:
    """Which of the seven signals of a case have fired."""
    c = F.col
    return {
        "rules": F.size("rules") > 0,
        "volume": c("is_anomaly"),
        "network": (c("destinations") > 0) | (c("ioc_neighbor") > 0) | (c("hops") > 0),
        "history": c("escalations") > 0,
        "similarity": c("similar") > 0,
        "tactics": F.size(along_chain(c("tactics"))) > 0,
        "campaign": c("campaign_id").isNotNull(),
    }


def _id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


def node(i: Column, kind: str, label: Column, status: Column | None = None) -> Column:
    return F.struct(i.alias("id"), F.lit(kind).alias("kind"), label.cast("string").alias("label"), (F.lit(None).cast("string") if status is None else status).alias("status"))


def edge(a: Column, b: Column, kind: str) -> Column:
    return F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"))


def each(values, f, most: int) -> Column:
    return F.transform(F.slice(values, 1, most), f)


def _several(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)


def case_graphs(cases: DataFrame, key: str = "event_id", verified: bool = False) -> DataFrame:
    """(key, nodes, edges, signals, density) of every case; nodes are (id, kind, label, status), edges (source, target, kind).

    Entities (host, address, user, rule, tactic, indicator, campaign, related alert) have ids of their own, what belongs to the
    case alone has its key in the id. Tactics are chained along the kill chain. With ``verified``, the checks that were made
    follow, each with its status, and what they found, and lead to the verdict. A node appears once in a case.
    """
    d = complete_cases(cases, key)
    c, own = F.col, lambda kind: _id(kind, F.col(key))
    real = lambda name: ~c(name).isin("", "unknown", "0.0.0.0", "n/a")
    when = lambda cond, *items: F.when(cond, F.array(*items)).otherwise(F.slice(F.array(*items), 1, 0))
    number = lambda name: F.format_string("%.2f", c(name))
    host, finding, history, network, campaign = _id("host", c("host")), own("finding"), own("history"), own("network"), _id("campaign", c("campaign_id"))
    tactics = along_chain(c("tactics"))
    word = lambda s: F.get(F.array(*map(F.lit, SEVERITY_WORDS)), s - 1)
    rule = lambda r: _id("rule", r["name"])
    tactic = lambda t: _id("tactic", t)
    ioc = c("ioc_neighbor") > 0
    nodes = [
        F.array(node(host, "host", c("host"))),
        when(real("src_ip"), node(_id("ip", c("src_ip")), "ip", c("src_ip"))),
        when(real("usr"), node(_id("user", c("usr")), "user", c("usr"))),
        each(c("rules"), lambda r: node(rule(r), "rule", F.concat_ws(" ", r["name"], word(r["severity"]))), 5),
        when(c("is_anomaly"), node(own("volume"), "volume", F.concat(F.lit("z "), number("z")))),
        when(c("destinations") > 0, node(network, "network", F.concat(c("destinations"), F.lit(" destinations, "), c("hops"), F.lit(" hops")))),
        when(ioc, node(own("indicator"), "indicator", F.lit("known indicator"))),
        when(c("lateral") > 0.1, node(own("lateral"), "lateral", number("lateral"))),
        when(c("c2") > 0.1, node(own("c2"), "c2", number("c2"))),
        when(c("escalations") > 0, node(history, "history", F.concat(c("escalations"), F.lit(" escalations")))),
        F.when(c("escalations") > 0, each(c("related"), lambda a: node(_id("alert", a), "alert", a), 6)).otherwise(each(c("related"), lambda a: node(_id("alert", a), "alert", a), 0)),
        when(c("similar") > 0, node(own("similarity"), "similarity", F.concat(c("similar"), F.lit(" similar, nearest "), number("nearest")))),
        F.transform(tactics, lambda t: node(tactic(t), "tactic", t)),
        when(c("campaign_id").isNotNull(), node(campaign, "campaign", c("campaign_id"))),
        F.when(c("campaign_id").isNotNull(), each(c("campaign_hosts"), lambda h: node(_id("host", h), "host", h), 5)).otherwise(each(c("campaign_hosts"), lambda h: node(_id("host", h), "host", h), 0)),
        F.array(node(finding, "finding", c("finding_type"))),
    ]
    first_tactic = tactic(F.get(tactics, F.lit(0)))
    edges = [
        when(real("src_ip"), edge(_id("ip", c("src_ip")), host, "connects")),
        when(real("usr"), edge(_id("user", c("usr")), host, "acts")),
        each(c("rules"), lambda r: edge(host, rule(r), "detects"), 5),
        when(c("is_anomaly"), edge(host, own("volume"), "deviates")),
        when(c("destinations") > 0, edge(host, network, "reaches")),
        when(ioc, edge(F.when(c("destinations") > 0, network).otherwise(host), own("indicator"), "meets")),
        when(c("lateral") > 0.1, edge(host, own("lateral"), "lateral")),
        when(c("c2") > 0.1, edge(host, own("c2"), "c2")),
        when(c("escalations") > 0, edge(history, host, "precedes")),
        F.when(c("escalations") > 0, each(c("related"), lambda a: edge(_id("alert", a), history, "relates"), 6)).otherwise(each(c("related"), lambda a: edge(_id("alert", a), history, "relates"), 0)),
        when(c("similar") > 0, edge(own("similarity"), host, "resembles")),
        when(F.size(tactics) > 0, edge(host, first_tactic, "begins")),
        F.transform(F.slice(F.arrays_zip(tactics.alias("a"), F.slice(tactics, 2, len(TACTICS) * 8).alias("b")), F.lit(1), F.greatest(F.size(tactics) - 1, F.lit(0))), lambda x: edge(tactic(x["a"]), tactic(x["b"]), "progresses")),
        F.when(F.size(tactics) > 0, each(c("rules"), lambda r: edge(rule(r), first_tactic, "triggers"), 3)).otherwise(each(c("rules"), lambda r: edge(rule(r), first_tactic, "triggers"), 0)),
        when(c("campaign_id").isNotNull(), edge(host, campaign, "takes part")),
        F.when(c("campaign_id").isNotNull(), each(c("campaign_hosts"), lambda h: edge(campaign, _id("host", h), "coordinates"), 5)).otherwise(each(c("campaign_hosts"), lambda h: edge(campaign, _id("host", h), "coordinates"), 0)),
        F.array(edge(host, finding, "found")),
    ]
    added = check_parts(key) if verified else ([], [])
    # nodes, edges and diagrams are all read from it, and filters on them meet a table instead of these expressions
    return written(_graphs(d, key, nodes + added[0], edges + added[1]), "graphs")


def check_parts(key: str) -> tuple[list[Column], list[Column]]:
    """Nodes and edges that the checks of a case add to its graph."""
    c, own = F.col, lambda kind: _id(kind, F.col(key))
    finding = own("finding")
    verdict, doubt = own("verdict"), c("false_positives") > c("true_positives")
    status = lambda good, other="fail": F.when(good, "pass").otherwise(other)
    checks = {
        "evidence": (status(c("verified") & c("intact")), F.concat(F.size("batches").cast("string"), F.lit(" batches"))),
        "indicators": (status(F.size("matches") > 0, "neutral"), F.concat(F.size("matches").cast("string"), F.lit(" matches, "), c("flows"), F.lit(" flows"))),
        "timeline": (status(c("coherent"), "warn"), F.concat(c("timeline_events"), F.lit(" events"))),
        "false positives": (status(~doubt), F.concat(c("false_positives"), F.lit(" of "), c("false_positives") + c("true_positives"))),
    }
    of = {name: _id(f"check:{name}", c(key)) for name in checks}
    nodes = [F.array(*[node(of[n], "check", label, s) for n, (s, label) in checks.items()]), each(c("batches"), lambda b: node(_id("batch", b), "batch", b), 5), each(c("matches"), lambda m: node(_id("indicator", m["value"]), "indicator", F.concat_ws(" ", m["value"], m["kind"])), 5), F.array(node(verdict, "verdict", F.concat_ws(" ", "verdict", "priority")))]
    edges = [F.array(*[edge(finding, of[n], "verifies") for n in checks]), each(c("batches"), lambda b: edge(of["evidence"], _id("batch", b), "holds"), 5), each(c("matches"), lambda m: edge(of["indicators"], _id("indicator", m["value"]), "matches"), 5), F.array(*[edge(of[n], verdict, "contributes") for n in checks])]
    return nodes, edges


def verification_graphs(cases: DataFrame, key: str = "event_id") -> DataFrame:
    """As ``case_graphs``, of the checks and the verdict alone."""
    return _graphs(complete_cases(cases, key), key, *check_parts(key))


def _graphs(d: DataFrame, key: str, nodes: list[Column], edges: list[Column]) -> DataFrame:
    fired = sum((F.coalesce(x, F.lit(False)).cast("int") for x in _signals().values()), F.lit(0))
    out = d.select(key, F.array_distinct(_several(nodes)).alias("nodes"), F.array_distinct(_several(edges)).alias("edges"), fired.alias("signals"))
    return out.withColumn("density", first_match([(F.col("signals") >= 4, F.lit("rich")), (F.col("signals") >= 2, F.lit("medium"))], F.lit("sparse")))


def graph_nodes(graphs: DataFrame, key: str = "event_id") -> DataFrame:
    return graphs.select(key, F.explode("nodes").alias("_n")).select(key, "_n.*")


def graph_edges(graphs: DataFrame, key: str = "event_id") -> DataFrame:
    return graphs.select(key, F.explode("edges").alias("_e")).select(key, "_e.*")


def merged_graph(graphs: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all cases together, each with the number of cases that have it."""
    nodes = graph_nodes(graphs, key).groupBy("id", "kind").agg(F.count("*").alias("cases"))
    return nodes, graph_edges(graphs, key).groupBy("source", "target", "kind").agg(F.count("*").alias("cases"))


def graph_diagram(graphs: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, diagram): a graph as the text of a flow chart; marks that the text gives a meaning are left out of labels."""
    plain = lambda s: F.substring(F.regexp_replace(s, r'["\[\]{}()<>|#&]', ""), 1, 40)
    name = lambda i: F.concat(F.lit("n"), F.array_position(F.transform("nodes", lambda n: n["id"]), i).cast("string"))
    boxes = F.transform("nodes", lambda n: F.concat(F.lit("  "), name(n["id"]), F.lit('["'), plain(F.concat_ws(" ", n["kind"], n["label"])), F.lit('"]')))
    lines = F.transform("edges", lambda e: F.concat(F.lit("  "), name(e["source"]), F.lit(" -->|"), e["kind"], F.lit("| "), name(e["target"])))
    return graphs.select(key, F.array_join(F.concat(F.array(F.lit("flowchart LR")), boxes, lines), "\n").alias("diagram"))


def two(name: str) -> Column:
    return F.format_string("%.2f", F.col(name))


def line(section: str, *parts) -> Column:
    return F.struct(F.lit(section).alias("section"), F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]).alias("line"))


def report_lines(cases: DataFrame, key: str = "event_id", verified: bool = False) -> DataFrame:
    """(key, place, section, line) of every case's report, in the order of ``place``; ``report_texts`` joins them.

    Sections: subject, trigger, a line under ``fired`` or ``not fired`` for each signal, kill chain and campaign where there are
    any, and the finding with its action. With ``verified``: evidence, indicators, timeline and false positives, each with a
    warning where one is due, and the verdict.
    """
    d = complete_cases(cases, key)
    c, text = F.col, F.lit
    tactics, names = along_chain(c("tactics")), F.array_join(F.transform(F.slice("rules", 1, 5), lambda r: r["name"]), ", ")
    details = {
        "rules": (F.size("rules"), " rules: ", names),
        "volume": ("z ", two("z")),
        "network": (c("destinations"), " destinations, ", c("hops"), " hops", F.when(c("ioc_neighbor") > 0, ", known indicator").otherwise("")),
        "history": (c("escalations"), " escalations, related ", F.array_join(F.slice("related", 1, 6), ", "), F.when(F.size("related") > 6, F.concat(text(" and "), (F.size("related") - 6).cast("string"), text(" more"))).otherwise("")),
        "similarity": (c("similar"), " similar attacks, nearest ", two("nearest")),
        "tactics": (F.size(tactics), " tactics"),
        "campaign": (F.size("campaign_hosts"), " hosts"),
    }
    signals = _signals()
    out = [
        line("subject", c("host"), " | ", F.coalesce(F.nullif("src_ip", text("")), text("n/a")), " | ", F.coalesce(F.nullif("usr", text("")), text("n/a")), " | triage ", two("score"), " | score ", two("case_score")),
        line("trigger", c("source"), F.when(c("message") != "", F.concat(text(": "), F.substring("message", 1, 200), F.when(F.length("message") > 200, "...").otherwise(""))).otherwise("")),
        *[F.when(signals[s], line("fired", s, ": ", *parts)) for s, parts in details.items()],
        *[F.when(~F.coalesce(signals[s], text(False)), line("not fired", s)) for s in details],
        F.when(F.size(tactics) > 0, line("kill chain", F.array_join(tactics, " > "))),
        F.when(F.size(tactics) > 1, line("kill chain", F.size(tactics), F.when(F.size(tactics) >= 3, " phases: advanced persistent threat").otherwise(" phases: multi-stage attack"))),
        F.when(signals["campaign"], line("campaign", c("campaign_id"), ": ", F.array_join(F.slice("campaign_hosts", 1, 10), ", "))),
        line("finding", c("finding_type"), " | ", finding_severity(c("finding_type")), " | ", finding_action(c("finding_type"))),
    ]
    return _lines(d, key, out + (check_lines(tactics) if verified else []))


def verification_lines(cases: DataFrame, key: str = "event_id") -> DataFrame:
    """As ``report_lines``, of the checks and the verdict alone."""
    return _lines(complete_cases(cases, key), key, check_lines(along_chain(F.col("tactics"))))


def check_lines(tactics: Column) -> list[Column]:
    c, text = F.col, F.lit
    fp, labels = c("false_positives"), c("false_positives") + c("true_positives")
    out = [
        line("evidence", F.when(c("verified"), "verified").otherwise("unverified"), ", chain ", F.when(c("intact"), "intact").otherwise("broken"), ", ", F.size("batches"), " batches"),
        F.when(~c("intact"), line("evidence", "warning: logs may have been changed between collection and analysis")),
        line("indicators", F.when(F.size("matches") > 0, "corroborated").otherwise("no match"), ", ", c("flows"), " flows"),
        F.when(F.size("matches") > 0, line("indicators", F.array_join(F.transform(F.slice("matches", 1, 5), lambda m: F.concat_ws(" ", m["value"], m["kind"])), ", "), F.when(F.size("matches") > 5, F.concat(text(" and "), (F.size("matches") - 5).cast("string"), text(" more"))).otherwise(""))),
        line("timeline", c("timeline_events"), " events, ", F.when(c("coherent"), "coherent").otherwise("out of order")),
        F.when(~c("coherent"), line("timeline", "warning: the sequence may not be that of the attack")),
        line("false positives", fp, " of ", labels, " labels"),
        F.when(fp > 0, line("false positives", F.when(2 * fp > labels, "high: similar alerts are mostly false").otherwise("moderate"))),
        line("verdict", c("verdict"), " | ", c("priority"), " | ", two("confidence"), " | ", verdict_action(c("verdict"), c("priority"), c("host"), c("src_ip"), c("finding_type"), tactics)),
    ]
    return out


def _lines(d: DataFrame, key: str, out: list[Column]) -> DataFrame:
    kept = F.filter(F.array(*out), lambda x: x.isNotNull())
    return d.select(key, F.posexplode(kept).alias("place", "_l")).select(key, "place", "_l.section", "_l.line")


def report_texts(lines: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, report): the lines in order, each with its section."""
    sorted_lines = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(": ", "section", "line").alias("text"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(sorted_lines, lambda x: x["text"]), "\n").alias("report"))
