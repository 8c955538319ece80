"""Folds that split a key by time against a plain loop over its rows."""

import random

import numpy as np
import pandas as pd
import pytest

from logloom.operators import folds, windows

SCHEMA = "event_id long, host string, us long, score double, severity int, step int, event_type string"


def made(n, seed, spread):
    draw = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += draw.choice(spread)
        rows.append((i, draw.choice(("hot", "hot", "hot", "b", None)), at, draw.random(), draw.randrange(6), draw.randrange(7), f"t{draw.randrange(5)}"))
    return rows


ROWS = made(700, 1, (0, 1, 400_000, 30_000_000, 200_000_000)) + [(9_000 + i, h, None, 0.9, 1, 2, "t0") for i, h in enumerate(("hot", None))]
BUSY = made(500, 2, (10_000_000, 60_000_000, 300_000_000, 4_000_000_000))


def whole(rows, fold, keys=("host",)):
    """Without segments: one frame for each key."""
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    df = df.sort_values(["us", "event_id"], kind="stable", na_position="last")
    return pd.concat([fold.step(fold.begin(), part) for _, part in df.groupby(list(keys), dropna=False)])


def compared(got, want):
    got, want = (x.sort_values("event_id", kind="stable").reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    assert got.event_id.tolist() == want.event_id.tolist()
    for c in set(want.columns) - {"host", "us", "event_type"}:
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9), c


@pytest.mark.parametrize("rows", [ROWS[:-2], BUSY])
@pytest.mark.parametrize("segment_rows", [10_000, 90, 7, 1])
def test_folds_are_those_of_whole_keys(spark, rows, segment_rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    compared(windows.ewma_rates(df, "host", segment_rows=segment_rows).toPandas(), whole(rows, folds.EwmaFold("us", (2.0, 60.0, 600.0), 300.0)))
    compared(windows.kill_chain(df, "host", "step", segment_rows=segment_rows).toPandas(), whole(rows, folds.KillChainFold("us", "step", 0.3, 3600.0)))
    high = [r for r in rows if r[3] >= 0.5]
    compared(windows.alert_gate(df, ["host"], least=0.5, segment_rows=segment_rows).toPandas(), whole(high, folds.GateFold("us", 300.0)))


def test_no_task_holds_more_than_a_segment(spark, tmp_path):
    """A key with nearly all rows is folded in as many parts as there are segments."""
    rows = made(2_000, 3, (1_000_000,))
    rows = [(i, "hot", *r[2:]) for i, r in enumerate(rows)]
    seen = f"{tmp_path}"

    class Spy(folds.GateFold):
        def summary(self, held):
            n = sum(len(h[0]) for h in held)
            with open(f"{seen}/{held[0][0][0]}", "w") as f:
                f.write(str(n))
            return super().summary(held)

    df = spark.createDataFrame(rows, SCHEMA)
    out = folds.fold_by_segments(df, ["host"], "us", "event_id", Spy("us", 300.0), df.schema, 100)
    assert out.count() == len(whole(rows, folds.GateFold("us", 300.0)))
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert len(sizes) == 20
    assert max(sizes) <= 101


def test_rows_without_time_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = windows.alert_gate(df, ["host"], least=0.0, segment_rows=50).toPandas()
    assert got.event_id.is_unique
    assert windows.ewma_rates(df.filter("false"), "host").count() == 0
    assert windows.kill_chain(df.filter("us is null"), "host", "step").count() == 2
    rates = windows.ewma_rates(df, "host", segment_rows=50).filter("us is null").toPandas()
    assert rates.rate_fast.tolist() == [1.0, 1.0]


def test_chain_leaves_as_a_loop_does():
    draw = np.random.default_rng(1)
    for after in (True, False):
        chain = folds.RestartChain(300.0, after)
        for _ in range(300):
            at = np.sort(draw.integers(1_000, 1_000 + draw.choice([50, 400, 3_000]), draw.integers(1, 30)))
            upto, last = chain.steps(at)
            begin = int(draw.integers(500, 1_000))
            want = begin
            for t in at.tolist():
                if t - want > 300 or (not after and t - want == 300):
                    want = t
            got = chain.leave(begin, at[upto].tolist(), at[last].tolist())
            assert (begin if got is None else got) == want


@pytest.mark.parametrize("segment_rows", [10_000, 60, 3])
def test_running_baseline_over_segments(spark, segment_rows):
    rows = ROWS[:-2]
    got = windows.running_baseline_z(spark.createDataFrame(rows, SCHEMA), "host", ["us", "event_id"], segment_rows=segment_rows).toPandas()
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).sort_values(["us", "event_id"])
    want = {}
    for _, part in df.groupby("host", dropna=False):
        for i in range(len(part)):
            x = part.score.to_numpy()[: i + 1]
            want[part.event_id.iloc[i]] = 0.0 if i < 9 or x.std() < 1e-6 else (x[-1] - x.mean()) / x.std()
    assert len(got) == len(want)
    assert all(abs(want[i] - z) < 1e-9 for i, z in zip(got.event_id, got.baseline_z, strict=True))
    assert set(got.columns) == {*df.columns, "baseline_z"}


def test_cross_hosts_by_pairs(spark):
    rows = [r for r in ROWS if r[2] is not None and r[1]]
    got = {r.event_id: r.cross_hosts for r in windows.cross_host_count(spark.createDataFrame(rows, SCHEMA)).collect()}
    high = [r for r in rows if r[3] >= 0.5]
    assert got == {r[0]: len({h[1] for h in high if r[2] - 900_000_000 <= h[2] <= r[2]}) if r[3] >= 0.5 else 0 for r in rows}
