"""Folds over a key's rows in time order that split a hot key by time (inventory L2; F9, F10, G5, H1).

1. Time is cut into segments, so many that each holds a bounded share of the rows.
2. Every segment of a key is summed up by itself: how it changes whatever state it is entered with.
3. The summaries of a key, a row for each segment, are applied one after the other: this gives each segment its state.
4. The rows of each segment are folded from that state, an Arrow batch at a time.

Steps 2 and 4 run for all segments at once, so a key with any share of the rows is spread over the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of all keys that a segment of time holds on average.
SEGMENT_ROWS = 2_000_000


class Fold:
    """A fold: states are dictionaries that JSON can hold; summaries are too."""

    #: Columns that a summary is made of, besides keys, time and order.
    reads: list[str] = []

    def begin(self) -> dict:
        """The state before a key's first row."""
        raise NotImplementedError

    def add(self, state: dict, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """What the fold adds to some rows in order; ``state`` is moved on. Of ``KEEP``, rows that are not true are left out."""
        raise NotImplementedError

    def step(self, state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        """The result of some rows in order; ``state`` is moved on."""
        return extended(rows, self.add(state, {c: rows[c].to_numpy() for c in rows.columns}))

    def gather(self, held: list[tuple[np.ndarray, ...]], rows: dict[str, np.ndarray]) -> None:
        """Keep what a summary needs of some rows."""
        raise NotImplementedError

    def summary(self, held: list[tuple[np.ndarray, ...]]) -> dict:
        raise NotImplementedError

    def apply(self, state: dict, summary: dict) -> dict:
        """The state after a segment that was entered with ``state``."""
        raise NotImplementedError


#: The column of ``Fold.add`` that tells which rows to keep.
KEEP = "_keep"


def extended(rows: pd.DataFrame, added: dict[str, np.ndarray]) -> pd.DataFrame:
    return rows[added[KEEP]] if KEEP in added else rows.assign(**added)


class RestartChain:
    """Windows that start with a row, and start anew with the first row that is a span later.

    Which row starts one hangs on where the one before began. A segment's summary says for every time of that beginning
    where the last window of the segment begins: a step function, whose steps are no more than the rows of one span.
    """

    def __init__(self, span: float, after: bool):
        self.span, self.side = span, "right" if after else "left"  # after: later than the span, not just at it

    def steps(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may start the segment's first window, the last of each run that leads to the same last window, and
        the row where that begins."""
        n = len(at)
        follow = np.searchsorted(at, at + self.span, side=self.side).tolist()
        last = np.arange(n)
        for i in range(n - 1, -1, -1):
            if follow[i] < n:
                last[i] = last[follow[i]]
        # a window that began before the segment is over a span after its first row at the latest
        entries = last[: int(np.searchsorted(at, at[0] + self.span, side="right")) + 1]
        ends = np.flatnonzero(np.append(entries[1:] != entries[:-1], True))
        return ends, entries[ends]

    def leave(self, begin: int | None, upto: list[int], exits: list) -> object | None:
        """Of ``exits`` by the times of ``steps``, the one for a window that began at ``begin``; None if that goes on."""
        if begin is None:
            return exits[0]
        k = int(np.searchsorted(upto, begin + self.span, side=self.side))
        return exits[k] if k < len(exits) else None


class EwmaFold(Fold):
    """Decayed rates, and distinct actions in a restarting window."""

    reads = ["severity", "event_type"]

    def __init__(self, us: str, half_lives: tuple[float, float, float], window_s: float):
        self.us, self.window_s = us, window_s
        self.halves = np.array([*half_lives, half_lives[1]])
        self.chain = RestartChain(window_s * 1e6, True)

    def begin(self) -> dict:
        return {"rates": [0.0] * 4, "last": None, "begin": None, "seen": []}

    def add(self, state: dict, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        error = (rows["severity"] >= 4).astype(float)
        fast, medium, slow, errors, distinct = [], [], [], [], []
        (a, m, s, e), last, begin, seen = state["rates"], state["last"], state["begin"], set(state["seen"])
        half_a, half_m, half_s, half_e = self.halves.tolist()
        span = self.window_s * 1e6
        for at, action, wrong in zip(rows[self.us].tolist(), rows["event_type"].tolist(), error.tolist(), strict=True):
            if last is not None:  # 0 before a key's first row
                gap = (at - last) / 1e6
                gap = gap if gap >= 0.001 else 0.001
                a, m, s, e = a * 0.5 ** (gap / half_a), m * 0.5 ** (gap / half_m), s * 0.5 ** (gap / half_s), e * 0.5 ** (gap / half_e)
            a, m, s, e = a + 1.0, m + 1.0, s + 1.0, e + wrong
            last = at
            if begin is None or at - begin > span:
                begin, seen = at, set()
            seen.add(action)
            fast.append(a)
            medium.append(m)
            slow.append(s)
            errors.append(e)
            distinct.append(len(seen))
        state.update(rates=[a, m, s, e], last=last, begin=begin, seen=list(seen))
        fast, slow = np.array(fast), np.array(slow)
        return {"rate_fast": fast, "rate_medium": np.array(medium), "rate_slow": slow, "error_rate": np.array(errors), "acceleration": fast / np.maximum(slow, 0.01), "unique_actions": np.array(distinct, int)}

    def gather(self, held: list, rows: dict[str, np.ndarray]) -> None:
        held.append((rows[self.us], (rows["severity"] >= 4).astype(float), rows["event_type"].astype(object)))

    def summary(self, held: list) -> dict:
        us, error, action = (np.concatenate(c) for c in zip(*held, strict=True))
        # seconds to the segment's last row, step by step a thousandth at least
        gaps = np.maximum(np.diff(us) / 1e6, 0.001)
        left = np.concatenate((np.cumsum(gaps[::-1])[::-1], [0.0]))
        weights = np.stack([np.ones(len(us))] * 3 + [error])
        rates = (weights * 0.5 ** (left / self.halves[:, None])).sum(1)
        upto, last = self.chain.steps(us)
        return {"rates": rates.tolist(), "elapsed": float(left[0]), "first": int(us[0]), "last": int(us[-1]), "all": distinct(action), "upto": us[upto].tolist(), "exits": [[int(us[k]), distinct(action[k:])] for k in last.tolist()]}

    def apply(self, state: dict, summary: dict) -> dict:
        rates = np.array(summary["rates"])
        if state["last"] is not None:
            gap = max((summary["first"] - state["last"]) / 1e6, 0.001)
            rates = rates + np.array(state["rates"]) * 0.5 ** ((gap + summary["elapsed"]) / self.halves)
        begin, seen = self.chain.leave(state["begin"], summary["upto"], summary["exits"]) or (state["begin"], summary["all"] + state["seen"])
        return {"rates": rates.tolist(), "last": summary["last"], "begin": begin, "seen": distinct(seen)}


def distinct(values) -> list:
    return sorted(set(values), key=str)


class GateFold(Fold):
    """Each key's rows that are at least a span after the last one kept."""

    def __init__(self, us: str, quiet_s: float):
        self.us, self.chain = us, RestartChain(quiet_s * 1e6, False)

    def begin(self) -> dict:
        return {"last": None}

    def add(self, state: dict, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        keep, last = [], state["last"]
        for at in rows[self.us].tolist():
            good = last is None or at - last >= self.chain.span
            last = at if good else last
            keep.append(good)
        state["last"] = last
        return {KEEP: np.array(keep, bool)}

    def gather(self, held: list, rows: dict[str, np.ndarray]) -> None:
        held.append((rows[self.us],))

    def summary(self, held: list) -> dict:
        us = np.concatenate([h[0] for h in held])
        upto, last = self.chain.steps(us)
        return {"upto": us[upto].tolist(), "exits": us[last].tolist()}

    def apply(self, state: dict, summary: dict) -> dict:
        last = self.chain.leave(state["last"], summary["upto"], summary["exits"])
        return {"last": state["last"] if last is None else last}


class KillChainFold(Fold):
    """Attack stage that only advances, on scores over a gate, until none has passed for long enough."""

    def __init__(self, us: str, stage: str, gate: float, idle_s: float):
        self.us, self.stage, self.gate, self.idle_s, self.reads = us, stage, gate, idle_s, [stage, "score"]

    def begin(self) -> dict:
        return {"now": 0, "last": None, "times": []}

    def add(self, state: dict, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        stages, speeds = [], []
        now, last, times = state["now"], state["last"], state["times"]
        for at, reached, score in zip(rows[self.us].tolist(), rows[self.stage].tolist(), rows["score"].tolist(), strict=True):
            last = at if last is None else last
            if at - last > self.idle_s * 1e6:
                now, times = 0, []
            if score > self.gate:
                if reached > now:
                    now = int(reached)
                    times = [*times[-4:], (at - last) / 1e6]
                last = at
            stages.append(now)
            speeds.append(1 / max(sum(times) / len(times), 1.0) if len(times) > 1 else 0.0)
        state.update(now=now, last=last, times=times)
        return {"chain_stage": np.array(stages, int), "chain_velocity": np.array(speeds, float)}

    def gather(self, held: list, rows: dict[str, np.ndarray]) -> None:
        passed = rows["score"] > self.gate
        at = rows[self.us]
        held.append((at[:1], at[passed], rows[self.stage][passed]))

    def summary(self, held: list) -> dict:
        """The first time; of the rows that pass before the first idle gap, the first and those of a higher stage than all
        before; the state after the last row, if an idle gap frees it from what was before."""
        at, reached = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        out = {"first": int(held[0][0][0]), "records": [], "last": None, "free": None}
        if not len(at):
            return out
        out["last"] = int(at[-1])
        gaps = np.flatnonzero(np.diff(at) > self.idle_s * 1e6) + 1
        head = int(gaps[0]) if len(gaps) else len(at)
        top = np.maximum.accumulate(reached[:head])
        rises = np.append(0, np.flatnonzero(top[1:] > top[:-1]) + 1)
        out["records"] = [[int(reached[i]), int(at[i]), int(at[i - 1]) if i else None] for i in rises.tolist()]
        if len(gaps):
            state = {"now": 0, "last": int(at[gaps[-1] - 1]), "times": []}
            rest = at[gaps[-1] :]
            self.add(state, {self.us: rest, self.stage: reached[gaps[-1] :], "score": np.full(len(rest), self.gate + 1.0)})
            out["free"] = {"now": state["now"], "times": state["times"]}
        return out

    def apply(self, state: dict, summary: dict) -> dict:
        last = summary["first"] if state["last"] is None else state["last"]
        if summary["last"] is None:
            return {"now": state["now"], "last": last, "times": state["times"]}
        now, times = state["now"], state["times"]
        for reached, at, before in summary["records"]:
            before = last if before is None else before
            if at - before > self.idle_s * 1e6:
                now, times = 0, []
            if reached > now:
                now, times = reached, [*times[-4:], (at - before) / 1e6]
        if summary["free"]:
            now, times = summary["free"]["now"], summary["free"]["times"]
        return {"now": now, "last": summary["last"], "times": times}


def runs(batch: pd.DataFrame, by: list[str], reads: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray], int, int]]:
    """(key, columns, from, to) of the runs of equal keys of a batch in its order: a key's rows may come in several runs, one
    after the other. Columns are arrays that are cut, so that many keys of few rows cost little."""
    if not len(batch):
        return
    keys = [batch[c].to_numpy() for c in by]
    change = np.zeros(len(batch) - 1, bool)
    for k in keys:
        change |= np.asarray(k[1:] != k[:-1], bool)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
    values = {c: batch[c].to_numpy() for c in reads}
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield tuple(None if pd.isna(k[a]) else k[a] for k in keys), {c: v[a:b] for c, v in values.items()}, a, b


def time_segments(df: DataFrame, us: str, segment_rows: int) -> DataFrame:
    """``df`` with ``_segment``: time in equal spans, so many that they hold ``segment_rows`` rows each on average; rows
    without a time have one of their own."""
    n, low, high = df.agg(F.count("*"), F.min(us), F.max(us)).first()
    count = max(1, -(-n // segment_rows))
    width = 1 if low is None else (high - low) // count + 1
    return df.withColumn("_segment", F.coalesce(F.floor((F.col(us) - F.lit(low or 0)) / width).cast("int"), F.lit(count)))


def fold_by_segments(df: DataFrame, keys: list[str], us: str, order: str, fold: Fold, schema: str | StructType, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``fold.step`` over each key's rows by time, then ``order``; a task holds no more than one segment of a key at a time.

    Null keys are a key of their own; rows without a time stand apart, folded from the beginning as if a thousandth of a
    second lay between them. The table is read three times: for the number of its rows, for the summaries, for the fold.
    """
    keyed = df.select("*", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    names = [f"_key{i}" for i in range(len(keys))]
    kinds = dict(keyed.dtypes)
    cut = time_segments(keyed, us, segment_rows)
    times = [F.asc_nulls_last(us), F.asc_nulls_last(order)]
    read = [us, *({*fold.reads} - {us})]

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, [], []
        for batch in batches:
            for key, rows, _, _ in runs(batch, [*names, "_segment"], read):
                if key != now:
                    if held:
                        out.append((*now, json.dumps(fold.summary(held))))
                    now, held = key, []
                fold.gather(held, rows)
                if len(out) >= 1_000:
                    yield pd.DataFrame(out, columns=[*names, "_segment", "_summary"])
                    out = []
        if held:
            out.append((*now, json.dumps(fold.summary(held))))
        if out:
            yield pd.DataFrame(out, columns=[*names, "_segment", "_summary"])

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key = tuple(None if pd.isna(x) else x for x in row[:-2])
                if key != now:
                    now, state = key, fold.begin()
                out.append((*key, int(row[-2]), json.dumps(state)))
                state = fold.apply(state, json.loads(row[-1]))
            if out:
                yield pd.DataFrame(out, columns=[*names, "_segment", "_state"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        for batch in batches:
            parts, states = [], batch["_state"].to_numpy()
            for key, rows, a, _ in runs(batch, [*names, "_segment"], read):
                if key != now:
                    now, state = key, json.loads(states[a]) if isinstance(states[a], str) else fold.begin()
                parts.append(fold.add(state, rows))
            if parts:
                added = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
                yield extended(batch.drop(columns=[*names, "_segment", "_state"]), added)

    key_types = ", ".join(f"{n} {kinds[n]}" for n in names)
    some = cut.select(*names, "_segment", us, *({order, *fold.reads} - {us}))
    summaries = some.filter(F.col(us).isNotNull()).repartition(*names, "_segment").sortWithinPartitions(*names, "_segment", *times).mapInPandas(sum_up, f"{key_types}, _segment int, _summary string")
    states = summaries.repartition(*names).sortWithinPartitions(*names, "_segment").mapInPandas(carry, f"{key_types}, _segment int, _state string")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    met = cut.alias("a").join(states.alias("b"), same & (F.col("a._segment") == F.col("b._segment")), "left").select("a.*", "b._state")
    return met.repartition(*names, "_segment").sortWithinPartitions(*names, "_segment", *times).mapInPandas(run, schema)
