"""Exact trailing windows over a stream (inventory J2).

For every row, what its key's rows in the seconds up to it amount to: counts, counts of the same service, sums of flags,
distinct actions. Rows may come out of order within the watermark, so they wait in the state until it has passed them;
then their windows are complete. The rows of a key lie in slots of time, a state entry each. An event-time timer for each slot
gives out its rows, and slots that no later window reaches are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from logloom.streaming.streams import with_state


@dataclass(frozen=True)
class Trailing:
    """A measure: ``count`` of rows, of rows with the ``same`` value, of ``distinct`` values, or the ``sum`` of a number."""

    name: str
    kind: str
    seconds: float
    column: str | None = None


def trailing_values(at: np.ndarray, values: np.ndarray | None, kind: str, span: int) -> np.ndarray:
    """The measure for every row; ``at`` ascends, and rows of one time count for each other."""
    low, high = np.searchsorted(at, at - span, side="left"), np.searchsorted(at, at, side="right")
    if kind == "count":
        return (high - low).astype(float)
    if kind == "sum":
        sums = np.concatenate(([0.0], np.cumsum(np.nan_to_num(values.astype(float)))))
        return sums[high] - sums[low]
    code = pd.factorize(values)[0]  # null is -1
    n = len(at)
    if kind == "same":
        out = np.zeros(n)
        for c in np.unique(code):
            own = np.flatnonzero(code == c)
            out[own] = np.searchsorted(own, high[own], side="left") - np.searchsorted(own, low[own], side="left")
        return np.where(code >= 0, out, 0.0)
    held, out, a, b, different = np.zeros(code.max(initial=-1) + 2, int), np.zeros(n), 0, 0, 0
    for i in range(n):
        while b < high[i]:
            different += held[code[b]] == 0 and code[b] >= 0
            held[code[b]] += 1
            b += 1
        while a < low[i]:
            held[code[a]] -= 1
            different -= held[code[a]] == 0 and code[a] >= 0
            a += 1
        out[i] = different
    return out


class TrailingProcessor(StatefulProcessor):
    def __init__(self, measures: list[Trailing], slot_us: int, row: str, us: str):
        self.measures, self.slot, self.row, self.us = measures, slot_us, row, us
        self.reach = max(int(m.seconds * 1_000_000) for m in measures)
        self.texts = sorted({m.column for m in measures if m.kind in ("same", "distinct")})
        self.numbers = sorted({m.column for m in measures if m.kind == "sum"})

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = [("at", LongType()), ("id", LongType()), *((c, StringType()) for c in self.texts), *((c, DoubleType()) for c in self.numbers)]
        self.names = [n for n, _ in columns]
        self.handle = handle
        self.slots = handle.getMapState("slots", StructType([StructField("slot", LongType())]), StructType([StructField(n, ArrayType(kind)) for n, kind in columns]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for slot, some in part.groupby(part[self.us] // self.slot):
                slot = (int(slot),)
                held = [list(x) for x in self.slots.getValue(slot)] if self.slots.containsKey(slot) else [[] for _ in self.names]
                held[0] += some[self.us].tolist()
                held[1] += some[self.row].tolist()
                for k, c in enumerate([*self.texts, *self.numbers], 2):
                    held[k] += [None if pd.isna(x) else x for x in some[c]]
                self.slots.updateValue(slot, tuple(held))
                self.handle.registerTimer((slot[0] + 1) * self.slot // 1_000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1_000 // self.slot - 1
        have = sorted(k[0] for k in self.slots.keys())
        parts = [self.slots.getValue((s,)) for s in have if now - self.reach // self.slot - 1 <= s <= now]
        columns = [sum((list(p[k]) for p in parts), []) for k in range(len(self.names))]
        frame = pd.DataFrame(dict(zip(self.names, columns, strict=True))).sort_values(["at", "id"], kind="stable", ignore_index=True)
        at = frame["at"].to_numpy(np.int64)
        own = at // self.slot == now
        out = {self.row: frame["id"].to_numpy(np.int64)[own]}
        for m in self.measures:
            out[m.name] = trailing_values(at, frame[m.column].to_numpy() if m.column else None, m.kind, int(m.seconds * 1_000_000))[own]
        # timers come in the order of time: what the next slot's windows do not reach is over
        for s in have:
            if (s + 1) * self.slot <= (now + 1) * self.slot - self.reach:
                self.slots.removeKey((s,))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def trailing_stream(df: DataFrame, keys: list[str], measures: list[Trailing], ts: str = "at", us: str = "us", row: str = "event_id", late: str = "10 minutes", slot_s: float = 225.0) -> DataFrame:
    """``row`` and the measures of every row, once the watermark has passed its slot of ``slot_s`` seconds.

    ``row`` and ``us`` are longs, ``us`` the microseconds of ``ts``. Rows later than the watermark are dropped by Spark. A key's state is its rows within the
    longest span, the slot and the lateness. Null values of ``same`` and ``distinct`` columns do not count, nor do null numbers.
    """
    processor = TrailingProcessor(measures, int(slot_s * 1_000_000), row, us)
    shape = ", ".join([f"{row} long", *(f"{m.name} double" for m in measures)])
    return with_state(df.withWatermark(ts, late)).groupBy(*keys).transformWithStateInPandas(processor, shape, "append", "eventTime")


def slot_end(us: Column, slot_s: float = 225.0) -> Column:
    """When a row's slot is over, in microseconds: from then on the watermark gives it out."""
    width = int(slot_s * 1_000_000)
    return (F.floor(us / width) + 1) * width
