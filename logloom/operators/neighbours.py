"""Exact nearest neighbours by cells and the triangle inequality (inventory N2, N3, H9).

1. Cells. Centres are learned on a bounded sample; every vector goes to the cell of its nearest centre and keeps its
   distance to it. A cell is known by its number of vectors and its radius.
2. Bounds. A query first searches the cells around it that hold k vectors together. Its k-th distance there is a bound,
   and a cell whose centre is further away than that and its radius cannot hold a nearer vector.
3. Search. The cells that are left are searched, less the vectors whose distance to their centre differs from the query's
   by more than the bound. So pruning loses nothing, whatever the centres; on vectors without any clusters it prunes little.

Cells that lie side by side are put together to groups of a block of vectors, and a query goes to each group once, not to each
of its cells: where nothing can be ruled out, queries are sent as often as there are blocks. Queries and vectors of a group
meet in blocks, whose products are taken in strips: no pair of them is a row, and a task holds two blocks however large a
cell is or how many queries it has. Only centres and cell sizes are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.scratch import written

#: Vectors that centres are learned on at most: those with the least hash of their id.
MAX_SAMPLE = 20_000
#: Cells at most, and vectors of a cell on average.
MAX_CELLS, CELL_ROWS = 2_048, 64
#: Vectors and queries of a block.
BLOCK, QUERIES = 8_192, 8_192
#: Queries of a block whose products are held at a time.
STRIP = 256
SLACK = 1e-9


def learn_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds from vectors drawn at random, in strips; empty cells keep their centre."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and the distance to it."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    length = (centres * centres).sum(1)
    for at in range(0, len(x), 1_024):
        some = x[at : at + 1_024]
        near[at : at + 1_024] = (length - 2 * some @ centres.T).argmin(1)
        far[at : at + 1_024] = np.sqrt(((some - centres[near[at : at + 1_024]]) ** 2).sum(1))
    return near, far


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = pa.concat_arrays([column])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def whole(vector: str, width: int) -> F.Column:
    """Whether a vector has the width and no null or non-finite component; others have no distance."""
    return F.coalesce((F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def first_k(query: np.ndarray, value: np.ndarray, k: int, ids: list | None = None, slack: float = 0.0) -> np.ndarray:
    """Places of the k least values of each query, in order; with ``ids`` ties go to the smaller id, without them all stay that
    are no more than ``slack`` over the k-th."""
    order = np.lexsort((value, query))
    q, v = query[order], value[order]
    start = np.append(0, np.flatnonzero(q[1:] != q[:-1]) + 1) if len(q) else np.zeros(0, int)
    length = np.diff(np.append(start, len(q)))
    last = np.repeat(v[start + np.minimum(k, length) - 1], length)
    kept = order[v <= last + slack]
    if ids is None:
        return kept
    ranked, out, seen = sorted(kept.tolist(), key=lambda i: (query[i], value[i], ids[i])), [], {}
    for i in ranked:
        n = seen[query[i]] = seen.get(query[i], 0) + 1
        if n <= k:
            out.append(i)
    return np.array(out, int)


def grouped_cells(centres: np.ndarray, size: np.ndarray, block: int) -> np.ndarray:
    """The group of each cell: cells in the order of the direction in which centres differ most, as many as hold a block
    together; a cell of more vectors is a group of its own."""
    apart = centres - centres.mean(0)
    order = np.argsort(apart @ np.linalg.eigh(apart.T @ apart)[1][:, -1], kind="stable")
    group, now, held = np.zeros(len(size), np.int64), 0, 0
    for c in order.tolist():
        if held and held + size[c] > block:
            now, held = now + 1, 0
        group[c] = now
        held += int(size[c])
    return group


def search_blocks(met: DataFrame, payload: list[str], width: int, k: int, drop_self: bool, centres: np.ndarray, radii: np.ndarray) -> DataFrame:
    """(query_id, payload, distance, compared): the k nearest within each group of ``met``, whose rows are queries and vectors
    of some cells, sorted by group. ``compared`` is how many vectors the query was compared with there."""
    by = ["_group", "_qblock", "_block"]
    names = ["query_id", *payload, "distance", "compared"]
    kinds = dict(met.dtypes)

    def best(part: pa.Table) -> Iterator[tuple]:
        is_query = part.column("_query").to_numpy()
        q, x = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(x):
            return
        cell = part.column("_cell").to_numpy()[x]
        x = x[np.argsort(cell, kind="stable")]
        cell = np.sort(cell)
        take = lambda name, at: part.column(name).take(pa.array(at)).to_pylist()
        a, b = (matrix(part.column("_vector").take(pa.array(at)).combine_chunks(), width) for at in (q, x))
        radius, bounds = part.column("_radius").to_numpy()[x], part.column("_bound").to_numpy()[q]
        query_ids, ids = take("query_id", q), take("id", x)
        rest = [take(c, x) for c in payload]
        own: dict = {}
        if drop_self:
            for j, i in enumerate(ids):
                own.setdefault(i, []).append(j)
        squares = (b * b).sum(1)
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        here = cell[cuts[:-1]]
        for at in range(0, len(q), STRIP):
            some, bound = a[at : at + STRIP], bounds[at : at + STRIP]
            length = (some * some).sum(1)
            loose = 1e-9 * (1 + length.max() + squares.max())
            compared, found = np.zeros(len(some), np.int64), []
            for c, lo, hi in zip(here.tolist(), cuts, cuts[1:], strict=False):
                gap = np.sqrt(((some - centres[c]) ** 2).sum(1))
                who = np.flatnonzero(gap - radii[c] <= bound + SLACK)
                if not len(who):
                    continue
                far = (length[who, None] + squares[lo:hi]) - 2 * (some[who] @ b[lo:hi].T)
                ring = np.abs(radius[lo:hi] - gap[who, None]) <= bound[who, None] + SLACK
                compared[who] += ring.sum(1)
                i, j = np.nonzero(ring & (far <= (bound * bound + loose)[who, None]))
                if len(i):
                    found.append((who[i], j + lo, far[i, j]))
            if drop_self:
                for i in range(len(some)):
                    compared[i] -= len(own.get(query_ids[at + i], ()))
            if not found:
                continue
            i, j, far = (np.concatenate(z) for z in zip(*found, strict=True))
            if drop_self:
                other = np.array([ids[y] != query_ids[at + w] for w, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j, far = i[other], j[other], far[other]
            # what the products leave for an exact look: all that may be among the k least
            near = first_k(i, far, k, slack=2 * loose)
            i, j = i[near], j[near]
            exact = np.sqrt(((b[j] - some[i]) ** 2).sum(1))
            for n in first_k(i, exact, k, [ids[y] for y in j.tolist()]).tolist():
                yield (query_ids[at + i[n]], *(c[j[n]] for c in rest), float(exact[n]), int(compared[i[n]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = types = None

        def found() -> pa.RecordBatch:
            rows = list(best(pa.Table.from_batches(held)))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            types = types or [pa.float64() if n == "distance" else pa.int64() if n == "compared" else batch.schema.field(n).type for n in names]
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in by], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[a].tolist())
                if key != now and held:
                    yield found()
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield found()

    shape = ", ".join(f"`{n}` {kinds.get(n, 'double' if n == 'distance' else 'long')}" for n in names)
    return met.mapInArrow(run, shape)


def nearest_neighbours(queries: DataFrame, corpus: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """The k nearest of ``corpus`` (id, vector, ...) for each of ``queries`` (query_id, query_vector), with the corpus's other
    columns, ``distance`` and ``rank``.

    Ties go to the smaller id. Query ids are unique. Vectors of another length than the commonest, and those that are null or
    hold null or non-finite components, have no distance and are left out on either side; ``drop_self`` leaves out the
    query's own id. Without vectors the result is empty; a query near fewer than k vectors gets these.
    """
    spark = corpus.sparkSession
    payload = [c for c in corpus.columns if c != "vector"]
    single = all(dict(d.dtypes)[c] == "array<float>" for d, c in ((corpus, "vector"), (queries, "query_vector")))
    held = "array<float>" if single else "array<double>"  # single precision takes half the room; products are in double
    own = corpus.select(*payload, F.col("vector").cast(held).alias("_vector"))
    common = own.filter(F.size("_vector") > 0).groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = common["n"] if common else 1
    own = own.filter(whole("_vector", width))
    sample = own.orderBy(F.xxhash64("id"), "id").limit(MAX_SAMPLE).select("_vector").collect()
    x = np.array([r[0] for r in sample], np.float64).reshape(-1, width)
    rows = own.count()
    centres = learn_centres(x, max(1, min(MAX_CELLS, rows // CELL_ROWS))) if len(x) else np.zeros((1, width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = nearest(matrix(batch.column(batch.schema.get_field_index("_vector")), width), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far)], names=[*batch.schema.names, "_cell", "_radius"])

    shape = lambda d: ", ".join(f"`{n}` {t}" for n, t in d.dtypes)
    index = written(own.mapInArrow(deal, shape(own) + ", _cell int, _radius double"), "cells")
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in index.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_radius").alias("r")).collect():
        size[r["_cell"]], radius[r["_cell"]] = r.n, r.r
    group = grouped_cells(centres, size, BLOCK)
    asked = queries.select("query_id", F.col("query_vector").cast(held).alias("_vector")).filter(whole("_vector", width))

    def groups(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        """A row for each group that a query searches: at first the nearest cells that hold enough, then the groups of all cells
        that its bound leaves."""
        own = np.arange(len(centres)) if home else group
        turn = np.argsort(own, kind="stable")
        starts = np.append(0, np.flatnonzero(np.diff(own[turn])) + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                some = batch.slice(at, STRIP)
                v = matrix(some.column(1), width)
                gap = np.sqrt(np.maximum(((v[:, None, :] - centres[None]) ** 2).sum(2) if len(centres) * width < 4_096 else (v * v).sum(1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(1), 0))
                if home:
                    order = np.argsort(gap, axis=1, kind="stable")
                    before = np.cumsum(size[order], axis=1) - size[order]
                    good = np.zeros(gap.shape, bool)
                    np.put_along_axis(good, order, before < k + drop_self, axis=1)
                else:
                    good = gap - radius <= some.column(2).to_numpy()[:, None] + 1e-6
                i, g = np.nonzero(np.logical_or.reduceat((good & (size > 0))[:, turn], starts, axis=1))
                for cut in range(0, len(i), 4_096):  # a query's vector stands in each of its rows
                    rest = some.take(pa.array(i[cut : cut + 4_096]))
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(own[turn[starts[g[cut : cut + 4_096]]]], pa.int32())], names=["query_id", "_vector", "_bound", "_group"])

    def search(bounded: DataFrame, home: bool) -> DataFrame:
        kind = dict(bounded.dtypes)["query_id"]
        own = np.arange(len(centres)) if home else group
        rows = np.bincount(own, size)
        wide = written(bounded.mapInArrow(lambda b: groups(b, home), f"query_id {kind}, _vector {held}, _bound double, _group int"), "asked")
        counts = wide.groupBy("_group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_qblocks"))
        spread = lambda n, salt, c: F.pmod(F.xxhash64(F.lit(salt), c), n).cast("int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        # a row for each cell: MAX_CELLS at most
        cells = spark.createDataFrame([(c, int(g), int(max(1, -(-rows[g] // BLOCK)))) for c, g in enumerate(own.tolist())], "_cell int, _group int, _blocks int")
        met = cells.join(F.broadcast(counts), "_group")
        left = wide.join(F.broadcast(met.select("_group", "_blocks", "_qblocks").distinct()), "_group").withColumn("_qblock", spread(F.col("_qblocks"), "q", "query_id")).withColumn("_block", upto("_blocks"))
        right = index.join(F.broadcast(met), "_cell").withColumn("_block", spread(F.col("_blocks"), "x", "id")).withColumn("_qblock", upto("_qblocks"))
        columns = ["_group", "_qblock", "_block", "_cell", "query_id", *payload, "_vector", "_radius", "_bound", "_query"]
        none = lambda d, names, of: d.withColumns({n: F.lit(None).cast(of[n]) for n in names})
        asks = none(left.withColumns({"_query": F.lit(True), "_cell": F.lit(-1), "_radius": F.lit(0.0)}), payload, dict(index.dtypes))
        holds = none(right.withColumns({"_query": F.lit(False), "_bound": F.lit(0.0)}), ["query_id"], {"query_id": kind})
        by = columns[:3]
        both = asks.select(*columns).unionByName(holds.select(*columns))
        return search_blocks(both.repartition(*by).sortWithinPartitions(*by), payload, width, k, drop_self, centres, radius)

    by_query = Window.partitionBy("query_id").orderBy("distance", "id")
    first = search(asked.withColumn("_bound", F.lit(float("inf"))), True)
    # the k-th distance in the cells around; none if there are fewer
    ranked = first.withColumn("_place", F.row_number().over(by_query)).filter(F.col("_place") == k)
    bounds = written(ranked.select("query_id", F.col("distance").alias("_bound")), "bounds")
    bounded = asked.join(bounds, "query_id", "left").select("query_id", "_vector", F.coalesce("_bound", F.lit(float("inf"))).alias("_bound"))
    # the cells around are searched again with all others, under the bound
    met = search(bounded, False)
    return met.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).drop("compared")
