"""Template mining against a plain greedy merge, over batches with kept state, and the counts of its templates."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.operators import detect
from logloom.plans import registry

registry.load_all()
DATA = "/root/testdata/sf0.001"


def messages(n, seed=1):
    draw = random.Random(seed)
    words = ["user", "host", "port", "open", "closed", "denied", "by", "policy", "at", "gate"]
    return [" ".join(["event", draw.choice(("login", "logout")), *draw.choices(words, k=draw.randrange(2, 6))]) for _ in range(n)] + ["", " ", None, "one", "one", "  padded  words here "]


def greedy(texts, leaders=None, similarity=0.4):
    """Signature to template, by comparing with every leader of the leaf."""
    leaders = {} if leaders is None else leaders
    counts, placed = Counter(t or "" for t in texts), {}
    for signature, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode())):
        tokens = signature.split()
        leaf = leaders.setdefault((len(tokens), *tokens[:2]), [])
        at = next((x for x in leaf if tokens and sum(a == b for a, b in zip(x, tokens, strict=True)) >= similarity * len(tokens)), None)
        if at is None:
            leaf.append(list(tokens))
            at = leaf[-1]
        else:
            at[:] = [a if a == b else "<*>" for a, b in zip(at, tokens, strict=True)]
        placed[signature] = at
    return {s: " ".join(x) for s, x in placed.items()}, counts


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, message string").repartition(4)


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_templates_are_those_of_a_greedy_merge(spark, batch):
    texts = messages(600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = detect.mine_templates(frame(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want, counts = greedy(texts)
    assert {r.signature: r.template for r in got} == want
    assert {r.signature: r.n for r in got} == counts
    sizes = Counter()
    for s, t in want.items():
        sizes[t] += counts[s]
    assert {r.template: r.template_count for r in got} == sizes
    assert len(sizes) < len(want) / 2


def test_mining_goes_on_from_batch_to_batch(spark):
    first, second = messages(300, 2), messages(300, 3)
    mined = detect.mine_templates(frame(spark, first))
    state = detect.template_state(mined)
    kept = {r.template for r in state.collect()}
    again = detect.mine_templates(frame(spark, second), known=state)
    placed = {r.signature: r.template for r in again.collect()}
    assert set(placed) == {t or "" for t in second}
    fits = [s for s, t in placed.items() if any(len(k.split()) == len(s.split()) and k.split()[:2] == s.split()[:2] for k in kept)]
    assert len(fits) > 50
    assert len({placed[s] for s in fits}) < len(fits) / 2
    assert detect.mine_templates(frame(spark, first), known=state).select("template").distinct().count() <= len(kept)
    later = detect.template_state(again, state)
    rows = {r.template: r.place for r in later.collect()}
    assert kept <= set(rows)
    assert len(rows) == later.count()
    assert max(rows[t] for t in kept) < min((rows[t] for t in rows if t not in kept), default=1 << 62)


def test_counts_are_of_mined_templates(spark):
    rows = registry.QUERIES["e7_mined_templates"](spark, DATA).collect()
    mined = registry.QUERIES["g7_mine_templates"](spark, DATA).collect()
    assert {r.template for r in rows} == {r.template for r in mined}
    assert sum(r.n for r in rows) == spark.read.parquet(f"{DATA}/events.parquet").count() == sum(r.n for r in mined)
    assert len({r.template for r in rows}) < 40


def test_empty(spark):
    df = frame(spark, ["a"]).filter(F.lit(False))
    assert detect.mine_templates(df).count() == 0
