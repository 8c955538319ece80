"""Counts over trailing spans of time as running totals of what enters and leaves them, without pairs of rows."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrences(facts: DataFrame, key: str, at: str, span: int, name: str) -> DataFrame:
    """Changes (key, at, ``name``) of the number of rows in the trailing ``span``: +1 at each row, -1 when it has passed."""
    met = facts.groupBy(key, at).agg(F.count("*").alias(name))
    leave = F.explode(F.array(F.struct(F.col(at).alias("at"), F.col(name).alias("n")), F.struct((F.col(at) + span + 1).alias("at"), (-F.col(name)).alias("n"))))
    return met.select(key, leave.alias("_c")).select(key, F.col("_c.at").alias("at"), F.col("_c.n").alias(name))


def appearances(facts: DataFrame, key: str, value: str, at: str, span: int, name: str) -> DataFrame:
    """Changes (key, at, ``name``) of the number of distinct values in the trailing ``span``.

    A value counts from a row on until ``span`` after it; rows no further apart are one appearance. Rows are first
    reduced to one for each key, value and slot of length ``span``, so a hot key or value shuffles few rows.
    """
    slots = facts.filter(F.col(value).isNotNull()).groupBy(key, value, F.floor(F.col(at) / span).alias("_slot")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    by = Window.partitionBy(key, value).orderBy("_slot")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(by) > span, F.lit(True))
    shuts = F.coalesce(F.lead("_first").over(by) - F.col("_last") > span, F.lit(True))
    ends = F.array(F.when(opens, F.struct(F.col("_first").alias("at"), F.lit(1).cast("long").alias("n"))), F.when(shuts, F.struct((F.col("_last") + span + 1).alias("at"), F.lit(-1).cast("long").alias("n"))))
    found = slots.withColumn("_ends", ends).select(key, F.explode(F.filter("_ends", lambda e: e.isNotNull())).alias("_c"))
    return found.select(key, F.col("_c.at").alias("at"), F.col("_c.n").alias(name))


def running_totals(left: DataFrame, key: str, at: str, changes: list[DataFrame], slot: int, row: str = "event_id") -> DataFrame:
    """(row, totals): for every row of ``left`` the sums of all changes of its key up to its time, itself included.

    One sweep over keys and slots of time: sums run within a slot, and those of earlier slots are added, so no row of
    ``left`` is paired with the rows before it and a hot key is spread over its slots.
    """
    names = [c for d in changes for c in d.columns[2:]]
    fill = lambda have: [(F.col(n) if n in have else F.lit(0).cast("long")).alias(n) for n in names]
    kind = left.schema[row].dataType
    rows = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(row).alias("_row"), F.lit(True).alias("_own"), *fill(()))
    for d in changes:
        rows = rows.unionByName(d.select(F.col(key).alias("_key"), F.col("at").alias("_at"), F.lit(None).cast(kind).alias("_row"), F.lit(False).alias("_own"), *fill(d.columns)))
    rows = rows.withColumn("_slot", F.floor(F.col("_at") / slot))
    within = Window.partitionBy("_key", "_slot").orderBy("_at")  # rows of the same time count in each other's sums
    run = rows.withColumns({n: F.sum(n).over(within) for n in names}).filter("_own")
    earlier = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_key", "_slot").agg(*[F.sum(n).alias(n) for n in names])
    before = sums.select("_key", "_slot", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names])
    return run.join(before, ["_key", "_slot"]).select(F.col("_row").alias(row), *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in names])


class Present:
    """Of each column the values that are present, and the least of the first column in order."""

    def __init__(self, columns: int, most: int):
        self.counts: list[Counter] = [Counter() for _ in range(columns)]
        self.order: list = []
        self.rows, self.most = 0, most

    def move(self, column: int, value, by: int) -> None:
        if column < 0:
            self.rows += by
            return
        counts = self.counts[column]
        before = counts[value]
        counts[value] += by
        if before == 0 and not column:
            insort(self.order, value)
        elif before + by == 0:
            del counts[value]
            if not column:
                del self.order[bisect_left(self.order, value)]


def swept(df: DataFrame, by: list[str], order: list[str], make: Callable, take: Callable, shape: str) -> DataFrame:
    """Rows of ``df`` in order, a state of ``make()`` for each group of equal ``by``: ``take(state, row)`` gives a result or None.
    A task holds one state at a time and a batch of rows, however many a group has."""
    names = [c.split()[0] for c in shape.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = []
            for key, row in zip(zip(*(columns[c] for c in by), strict=True), zip(*columns.values(), strict=True), strict=True):
                if key != now:
                    now, state = key, make()
                found = take(state, row)
                if found is not None:
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names=names)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, shape)


def present_values(left: DataFrame, facts: DataFrame, key: str, at: str, columns: list[str], span: int, row: str, most: int) -> DataFrame:
    """(row, key, n_*, first): for every row of ``left`` whose key has rows in the trailing ``span`` the number of distinct values of
    each column there, and the first ``most`` in order of the first column.

    Rows are reduced to the first and the last of each value in each slot of the span's length. From the first on until
    the span after the last the value is present; that enters and leaves each slot that it touches, three at most. A slot
    of a key is swept in order of time, and the values that are present just then are held.
    """
    good = facts.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    slot = lambda c: F.floor(c / span)
    kinds = dict(facts.dtypes)
    values = [F.lit(None).cast(kinds[c]).alias(f"_v{i}") for i, c in enumerate(columns)]
    rows = None
    for i in range(-1, len(columns)):  # -1: rows, whatever their values
        own = good if i < 0 else good.filter(F.col(columns[i]).isNotNull())
        by = [F.col(key).alias("_key"), slot(F.col(at)).alias("_of"), *([] if i < 0 else [F.col(columns[i]).alias(f"_v{i}")])]
        spans = own.groupBy(*by).agg(F.min(at).alias("_from"), (F.max(at) + span + 1).alias("_to"))
        dealt = spans.withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to")))))
        ends = F.array(F.struct(F.greatest("_from", F.col("_slot") * span).alias("at"), F.lit(1).alias("by")), F.struct(F.col("_to").alias("at"), F.lit(-1).alias("by")))
        moves = dealt.withColumn("_end", F.explode(ends)).filter(slot(F.col("_end.at")) == F.col("_slot"))
        some = moves.select("_key", "_slot", F.col("_end.at").alias("_at"), F.lit(i).alias("_column"), F.col("_end.by").alias("_by"), *[F.col(f"_v{j}") if j == i else v for j, v in enumerate(values)], F.lit(None).cast(dict(left.dtypes)[row]).alias("_row"))
        rows = some if rows is None else rows.unionByName(some)
    asks = left.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), slot(F.col(at)).alias("_slot"), F.col(at).alias("_at"), F.lit(0).alias("_column"), F.lit(0).alias("_by"), *values, F.col(row).alias("_row"))
    # at the same time what is present moves before rows ask
    both = rows.unionByName(asks).withColumn("_asks", F.col("_by") == 0)
    place = {c: i for i, c in enumerate(both.columns)}
    n = len(columns)

    def take(state: Present, r: tuple) -> tuple | None:
        if not r[place["_asks"]]:
            column = r[place["_column"]]
            state.move(column, r[place[f"_v{column}"]] if column >= 0 else None, r[place["_by"]])
            return None
        return (r[place["_row"]], r[place["_key"]], *(len(c) for c in state.counts), state.order[: state.most]) if state.rows else None

    shape = ", ".join([f"{row} {dict(left.dtypes)[row]}", f"{key} {dict(left.dtypes)[key]}", *(f"n_{c} long" for c in columns), f"first array<{kinds[columns[0]]}>"])
    return swept(both, ["_key", "_slot"], ["_at", "_asks", F.desc("_by")], lambda: Present(n, most), take, shape)


class Trail:
    """What rows of the trailing span add up to, and the newest of them."""

    def __init__(self, columns: int, most: int):
        self.counts: list[Counter] = [Counter() for _ in range(columns)]
        self.odd: Counter = Counter()
        self.rows = self.total = 0
        self.newest: deque = deque(maxlen=most)

    def move(self, values: tuple, score: float, by: int) -> None:
        self.rows += by
        if math.isfinite(score):
            self.total += by * round(score * UNIT)  # whole numbers do not drift
        else:
            self.odd[score] += by
        for counts, v in zip(self.counts, values, strict=True):
            if v is not None:
                counts[v] += by
                if not counts[v]:
                    del counts[v]

    def mean(self) -> float:
        odd = sum(v * n for v, n in self.odd.items() if n)
        return (self.total / UNIT + odd) / self.rows if self.rows else 0.0


UNIT = 1 << 52


def trailing_rows(left: DataFrame, facts: DataFrame, keys: list[str], at: str, columns: list[str], score: str, span: int, row: str, most: int) -> DataFrame:
    """(row, rows, n_*, mean, newest): for every row of ``left`` how many rows of ``facts`` have its keys and lie in its trailing
    ``span``, those with its own ``row`` left out, their distinct values of each column, their mean score and the time and ``row``
    of the newest ``most``.

    No row is paired with the rows before it: in the order of time rows enter and leave what is counted, slot by slot of the
    span's length; those of a slot enter the next one at its beginning. Only the newest rows are held. The table's rows
    with the row's own id are found by a join.
    """
    real = lambda d: d.filter(F.col(at).isNotNull()).dropna(subset=keys)
    asked, good = real(left), real(facts)
    kinds = dict(left.dtypes)
    own = asked.select(row, *keys, at).distinct().join(good.select(row, *keys, F.col(at).alias("_fact_at"), *columns, score), [row, *keys]).filter(F.col("_fact_at").between(F.col(at) - span, F.col(at)))
    own = own.groupBy(row, *keys, at).agg(F.collect_list(F.struct(*columns, score)).alias("_own"))
    asked = asked.join(own, [row, *keys, at], "left")
    slot = F.floor(F.col(at) / span)
    move = lambda s, when, by: F.struct(s.alias("slot"), when.alias("at"), F.lit(by).alias("by"))
    # rows leave just after the span has passed, in the slot after theirs or, at its end, not within it
    leave = F.col(at) + span + 1
    moves = F.array(move(slot, F.col(at), 1), move(slot + 1, (slot + 1) * span, 1), F.when(F.floor(leave / span) == slot + 1, move(slot + 1, leave, -1)))
    entered = good.withColumn("_m", F.explode(F.filter(moves, lambda m: m.isNotNull())))
    rows = entered.select(*keys, F.col("_m.slot").alias("_slot"), F.col("_m.at").alias("_when"), F.lit(False).alias("_asks"), F.col("_m.by").alias("_by"), at, F.col(row), *columns, F.col(score).cast("double").alias(score))
    asks = asked.select(*keys, slot.alias("_slot"), F.col(at).alias("_when"), F.lit(True).alias("_asks"), F.lit(0).alias("_by"), at, row, *[F.lit(None).cast(dict(facts.dtypes)[c]).alias(c) for c in columns], F.lit(None).cast("double").alias(score), "_own")
    both = asks.unionByName(rows, allowMissingColumns=True)
    place = {c: i for i, c in enumerate(both.columns)}
    n, names = len(columns), columns

    def take(state: Trail, r: tuple) -> tuple | None:
        if not r[place["_asks"]]:
            by = r[place["_by"]]
            state.move(tuple(r[place[c]] for c in names), r[place[score]], by)
            mark = (r[place[at]], r[place[row]])
            if by > 0 and not (state.newest and state.newest[-1] == mark):
                state.newest.append(mark)
            return None
        mine, oldest, own = r[place[row]], r[place[at]] - span, r[place["_own"]] or []
        for o in own:
            state.move(tuple(o[c] for c in names), o[score], -1)
        out = (mine, state.rows, *(len(c) for c in state.counts), state.mean(), [{"at": t, "id": i} for t, i in reversed(state.newest) if t >= oldest and i != mine][:most])
        for o in own:
            state.move(tuple(o[c] for c in names), o[score], 1)
        return out

    shape = ", ".join([f"{row} {kinds[row]}", "rows long", *(f"n_{c} long" for c in columns), "mean double", f"newest array<struct<at:bigint,id:{kinds[row]}>>"])
    # rows that leave come before those that ask at the same time: they have passed; those that enter come in the order of their own time
    return swept(both, [*keys, "_slot"], ["_when", "_asks", at, row], lambda: Trail(n, 2 * most), take, shape)
