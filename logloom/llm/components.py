"""Connected components and bucketed links, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save

#: Members of a bucket that are compared with each other in one go; larger buckets are cut into blocks of about this size.
BLOCK = 1024


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the links (two long columns), the component being its least node.

    Alternating star contraction: every node hands its larger neighbours to the least node that it knows, then every
    node its smaller ones. The links shrink to one star for each component in a number of rounds that grows with the
    logarithm of the largest component. Minima are pre-aggregated, joins on a hub are split by Spark's skew handling,
    and each round is a table in the shared folder.
    """
    edges = save(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u < v").distinct(), "links")
    state = None
    while True:
        # large star: a node's larger neighbours move to the least of its neighbours and itself
        both = edges.union(edges.select("u", "v")).toDF("n", "other")
        least = both.groupBy("n").agg(F.min("other").alias("m")).select("n", F.least("n", "m").alias("m"))
        moved = both.filter("other > n").join(least, "n").select(F.col("other").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = moved.groupBy("v").agg(F.min("u").alias("m"))
        moved = moved.join(least, "v")
        after = moved.select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").union(moved.select("v", F.col("m").alias("u"))).distinct()
        after = save(after, "links")
        drop(edges)
        edges = after
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % (1 << 40))).first()
        if seen == state:
            break
        state = seen
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.union(edges.select("u", "u").distinct().toDF("node", "component"))


def spread(rows: DataFrame, per_task: int = 20_000) -> DataFrame:
    """A written table of small rows, dealt out evenly over enough tasks for what each row is about to grow to."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))
    return rows.repartition(tasks, *rows.columns)


def in_blocks(rows: DataFrame, key: str, member: str, heavy: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows dealt so that any two members of a key meet in a bounded group, groups of one left out, sorted by group.

    Adds ``own`` (the member's block) and the group's ``low`` and ``high`` block. A key of up to ``block`` rows is one
    group (0, 0). A larger one is cut into blocks by the member's hash, and each pair of blocks is a group, so a pair
    of members of different blocks meets once, and two of one block are to be compared where low = high. ``heavy`` has
    (key, n) for the keys of more than ``block`` rows at least, with their number of rows or a bound of it.
    """
    heavy = save(heavy.toDF(key, "_n").filter(F.col("_n") > block), "heavy")
    if heavy.count() <= 200_000:  # two numbers each
        heavy = F.broadcast(heavy)
    dealt = rows.join(heavy, key, "left").withColumn("_blocks", F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), member), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    met = dealt.withColumn("_with", other).withColumns({"low": F.least("own", "_with"), "high": F.greatest("own", "_with")}).drop("_with", "_n", "_blocks")
    by = [key, "low", "high"]
    # the window's sort and partitioning are those that the groups need next
    alone = F.count("*").over(Window.partitionBy(*by))
    return met.repartition(*by).withColumn("_met", alone).filter("_met > 1").drop("_met").sortWithinPartitions(*by)


def group_runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``by``, with the starts of the groups (and the end)."""
    held: pa.Table | None = None

    def cuts(rows: pa.Table) -> np.ndarray:
        changed = np.zeros(max(0, rows.num_rows - 1), bool)
        for name in by:
            values = rows.column(name).to_numpy()
            changed |= values[1:] != values[:-1]
        return np.concatenate(([0], np.flatnonzero(changed) + 1))

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        held = rows if held is None else pa.concat_tables([held, rows])
        starts = cuts(held)
        if len(starts) > 1:
            yield held.slice(0, int(starts[-1])), starts
            held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held, np.append(cuts(held), held.num_rows)


def run_pairs(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, as arrays of row numbers, some at a time."""
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    rows = np.arange(starts[0], starts[-1])
    shift = 1
    while True:
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            return
        yield rows, rows + shift
        shift += 1


class Forest:
    """Union-find over the links that one task finds, to emit a spanning forest of them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            self.up[y] = x
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def links(self) -> tuple[list[int], list[int]]:
        found = [(x, self.root(x)) for x in list(self.up)]
        return [x for x, y in found if x != y], [y for x, y in found if x != y]


class Segments:
    """Hamming tables over 64-bit codes: (column, lowest bit, bit after the highest) of each.

    A row is entered in a table once for each bit of its segment, with that bit left out, so two rows share an entry if
    their segments differ in one bit or none. An entry packs table, left-out bit and the segment's other bits in a long.
    """

    def __init__(self, tables: list[tuple[str, int, int]]):
        if any(high - low > 48 for _, low, high in tables) or len(tables) > 511:
            raise ValueError("segments are too long to be packed, or too many")
        self.tables = tables

    @staticmethod
    def cut(column: str, low: int, high: int) -> F.Column:
        return F.shiftrightunsigned(F.col(column), low).bitwiseAND(F.lit((1 << (high - low)) - 1))

    def entries(self) -> F.Column:
        return F.array(*[self.cut(c, low, high).bitwiseAND(F.lit(~(1 << b))).bitwiseOR(F.lit((t << 6 | b) << 48)) for t, (c, low, high) in enumerate(self.tables) for b in range(high - low)])

    def heavy(self, codes: DataFrame, block: int = BLOCK) -> DataFrame:
        """(entry, bound of its rows) of all entries that may have more than ``block`` rows.

        An entry joins two values of a segment, one of which has over half of its rows. So only the segments are
        counted, a few for each row, and only the entries of frequent ones are formed.
        """
        values = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), self.cut(c, low, high).alias("value")) for t, (c, low, high) in enumerate(self.tables)])
        often = codes.select(F.explode(values).alias("s")).groupBy("s.t", "s.value").agg(F.count("*").alias("n")).filter(F.col("n") > block // 2)
        width = F.element_at(F.array(*[F.lit(high - low) for _, low, high in self.tables]), (F.col("t") + 1).cast("int"))
        each = often.withColumn("b", F.explode(F.sequence(F.lit(0), width - 1)))
        others = F.element_at(F.array(*[F.lit(~(1 << b)) for b in range(48)]), F.col("b") + 1)
        entry = F.col("value").bitwiseAND(others).bitwiseOR((F.col("t") * 64 + F.col("b")) * F.lit(1 << 48))
        return each.groupBy(entry.alias("entry")).agg((F.sum("n") + block // 2).alias("n"))

    def first_entry(self, codes: list[np.ndarray], other: list[np.ndarray], columns: list[str]) -> np.ndarray:
        """The number ``table << 6 | bit`` of the first entry that two rows of codes share; -1 if none."""
        out = np.full(len(codes[0]), -1, np.int64)
        differ = {c: (x ^ y).view(np.uint64) for c, x, y in zip(columns, codes, other, strict=True)}
        for t in range(len(self.tables) - 1, -1, -1):
            c, low, high = self.tables[t]
            d = differ[c] >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
            bit = np.where(d > 0, np.bitwise_count(np.maximum(d, 1) - np.uint64(1)), 0).astype(np.int64)
            out = np.where(np.bitwise_count(d) <= 1, t << 6 | bit, out)
        return out


def spanning_links(rows: DataFrame, verify: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray], columns: tuple[str, ...], key: str, member: str, heavy: DataFrame) -> DataFrame:
    """Links (a, b) that span what ``verify`` accepts among members that share a key.

    Each task compares the pairs of its groups in numpy and hands on a spanning forest of the pairs accepted, never
    the pairs themselves.
    """
    groups = in_blocks(rows, key, member, heavy).select(key, "low", "high", member, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for part, starts in group_runs(batches, (key, "low", "high")):
            members = part.column(member).to_numpy()
            for i, j in run_pairs(starts):
                good = verify(part, i, j)
                forest.link(members[i[good]], members[j[good]])
        a, b = forest.links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")
