"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned on a bounded sample so that the signs of the rotated coordinates make
balanced binary codes. A code is cut into segments, one Hamming table each; a segment is entered with each of its bits
left out, so two vectors meet in a table if their segments differ in one bit or none. Pairs that meet are filtered by
the distance of their codes and reranked by the cosine of the original vectors.

How many bits differ at the least cosine hangs on the data: where all vectors share a direction, centring them, which
keeps codes balanced, widens the angles between them. So pairs at that cosine are made from the sample, those in it are
looked up, and rotations are added, each with a code and tables of its own, until the tables find enough of both.

Where vectors lie so close to their mean that the rotations allowed do not find enough of them, the pairs at the least
cosine are hardly closer than any two vectors, and no code tells them apart. Then, and for lengths of few vectors beside
the commonest, an exact way is taken: blocks of vectors meet once each and are compared by matrix products.

Two rounds keep the shuffles small: the first carries codes only and finds which vectors have a candidate in which
entry, the second brings the vectors to just those entries. A pair may meet in several entries and counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, save, table
from .components import Forest, Segments, connected_components, group_runs, in_blocks, run_pairs, spread

COSINE = 0.9
TABLES = 5
MAX_BITS = 64
#: Vectors that the rotations are learned on at most: those with the least hash.
MAX_SAMPLE = 20_000
#: Share of the pairs at the least cosine that the tables must find; closer pairs are found more often.
BOUNDARY_RECALL = 0.94
#: Rotations at most. Where they do not suffice, pairs are compared exactly.
MAX_ROTATIONS = 16
#: Lengths that get tables of their own: the commonest, and those of so many vectors, up to so many lengths.
OWN_TABLES, MAX_LENGTHS = 20_000, 8
#: Vectors of a block of the exact way.
EXACT_BLOCK = 4_096


class Quantiser:
    """Mean, axes and rotations of the codes, and the tables over them."""

    def __init__(self, sample: np.ndarray, cosine: float = COSINE, rounds: int = 30, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        x = sample - self.mean
        self.bits = min(MAX_BITS, sample.shape[1])
        _, main = np.linalg.eigh(x.T @ x)
        self.main = main[:, ::-1][:, : self.bits]
        self.axes: list[np.ndarray] = []
        count = min(TABLES, self.bits)
        self.edges = [self.bits * i // count for i in range(count + 1)]
        pairs = self.boundary_pairs(sample, cosine, draw) + self.sample_pairs(sample, cosine)
        v = (x @ self.main)[draw.permutation(len(x))[:5000]]
        while True:
            self.axes.append(self.main @ self.rotation(v, rounds, draw))
            self.columns = [f"code{r}" for r in range(len(self.axes))]
            self.tables = Segments([(c, low, high) for c in self.columns for low, high in zip(self.edges[:-1], self.edges[1:], strict=True)])
            codes = [(self.codes(a), self.codes(b)) for a, b in pairs]
            apart = [sum(np.bitwise_count((p ^ q).view(np.uint64)).astype(int) for p, q in zip(a, b, strict=True)) for a, b in codes]
            # a pair at the least cosine differs in more bits than this about once in 1,000
            self.most = int(max(np.quantile(d, 0.999) for d in apart)) + 1
            found = [((self.tables.first_entry(a, b, self.columns) >= 0) & (d <= self.most)).mean() for (a, b), d in zip(codes, apart, strict=True)]
            # what the rotations allowed would find at this rate
            promise = 1 - (1 - min(found)) ** (MAX_ROTATIONS / len(self.axes))
            if min(found) >= BOUNDARY_RECALL or len(self.axes) == MAX_ROTATIONS or promise < BOUNDARY_RECALL - 0.1:
                break
        #: Share of the pairs at the least cosine that tables and limit find; under BOUNDARY_RECALL they do not suffice.
        self.boundary_recall = float(min(found))

    def rotation(self, v: np.ndarray, rounds: int, draw: np.random.Generator) -> np.ndarray:
        rotation = np.linalg.qr(draw.standard_normal((self.bits, self.bits)))[0]
        for _ in range(rounds):
            signs = np.where(v @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ v)
            rotation = (left @ right).T
        return rotation

    @staticmethod
    def boundary_pairs(sample: np.ndarray, cosine: float, draw: np.random.Generator, n: int = 4000) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs at just the cosine, turned in any direction and in that of the difference of two vectors."""
        a = sample[draw.integers(0, len(sample), n)]
        out = []
        for way in (draw.standard_normal(a.shape), sample[draw.integers(0, len(sample), n)] - sample[draw.integers(0, len(sample), n)]):
            way = way - (way * a).sum(1, keepdims=True) * a
            length = np.sqrt((way * way).sum(1, keepdims=True))
            good = length[:, 0] > 1e-9
            out.append((a[good], cosine * a[good] + np.sqrt(1 - cosine * cosine) * way[good] / length[good]))
        return [p for p in out if len(p[0])] or [(a, a)]

    @staticmethod
    def sample_pairs(sample: np.ndarray, cosine: float, n: int = 4000, most: int = 20_000) -> list[tuple[np.ndarray, np.ndarray]]:
        """The pairs of the sample's first vectors that have the cosine, if there are enough to tell."""
        some, left, right = sample[:n], [], []
        for at in range(0, len(some), 500):
            i, j = np.nonzero(some[at : at + 500] @ some.T >= cosine)
            left.append((i + at)[i + at < j])
            right.append(j[i + at < j])
        i, j = np.concatenate(left)[:most], np.concatenate(right)[:most]
        return [(some[i], some[j])] if len(i) >= 200 else []

    def codes(self, unit: np.ndarray) -> list[np.ndarray]:
        out = []
        for axes in self.axes:
            padded = np.zeros((len(unit), MAX_BITS), bool)
            padded[:, : self.bits] = ((unit - self.mean) @ axes) >= 0
            out.append(np.packbits(padded, axis=1, bitorder="little").view(np.int64)[:, 0])
        return out


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors scaled to length 1, in double precision, cut or zero-padded to a width."""
    out = np.zeros((len(vectors), width))
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()
    if len(lengths) and (lengths == width).all():
        out = flat[starts[0] : starts[-1]].reshape(-1, width).copy()
    else:
        for i, n in enumerate(lengths.tolist()):
            m = min(n, width)
            out[i, :m] = flat[starts[i] : starts[i] + m]
    out /= np.maximum(np.abs(out).max(1, keepdims=True, initial=0), 1e-300)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


LINKS = "node long, other long, links long"


def link_batch(forest: Forest, links: dict[int, int]) -> pa.RecordBatch:
    """A spanning forest of a task's links, and how many vectors each of its classes links with."""
    a, b = forest.links()
    return pa.RecordBatch.from_arrays([pa.array([*a, *links], pa.int64()), pa.array([*b, *[None] * len(links)], pa.int64()), pa.array([*[None] * len(a), *links.values()], pa.int64())], names=["node", "other", "links"])


def vectors_of(part: pa.Table) -> pa.ListArray:
    column = part.column("vector").combine_chunks()
    return pa.concat_arrays([column.chunk(0) if isinstance(column, pa.ChunkedArray) else column])


def links_by_tables(classes: DataFrame, quantiser: Quantiser, width: int, cosine: float) -> DataFrame:
    """Links among classes (node, n, vector) of one length, whose candidates meet in the tables."""
    columns, most = quantiser.columns, quantiser.most

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, quantiser.codes(unit_rows(batch.column(1), width)))], names=["node", *columns])

    def candidates(part: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        entry, own, low, high, *codes = (part.column(c).to_numpy() for c in ("entry", "own", "low", "high", *columns))
        for i, j in run_pairs(starts):
            # members of one block meet in all groups of that block, and count in its own; others only once
            meet = (own[i] != own[j]) | (low[i] == high[i])
            meet &= sum(np.bitwise_count((c[i] ^ c[j]).view(np.uint64)).astype(np.int64) for c in codes) <= most
            i, j = i[meet], j[meet]
            good = quantiser.tables.first_entry([c[i] for c in codes], [c[j] for c in codes], columns) == entry[i] >> 48
            yield i[good], j[good]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in group_runs(batches, ("entry", "low", "high")):
            has = np.zeros(part.num_rows, bool)
            for i, j in candidates(part, starts):
                has[i - starts[0]] = has[j - starts[0]] = True
            yield from part.filter(pa.array(has)).combine_chunks().to_batches()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, links = Forest(), {}
        for part, starts in group_runs(batches, ("entry", "low", "high")):
            nodes, sizes = part.column("node").to_numpy(), part.column("n").to_numpy()
            unit = unit_rows(vectors_of(part), width)
            counts = np.zeros(part.num_rows, np.int64)
            for i, j in candidates(part, starts):
                for at in range(0, len(i), 50_000):
                    a, b = i[at : at + 50_000], j[at : at + 50_000]
                    good = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                    a, b = a[good], b[good]
                    np.add.at(counts, a, sizes[b])
                    np.add.at(counts, b, sizes[a])
                    forest.link(nodes[a], nodes[b])
            for x, c in zip(nodes[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
                links[x] = links.get(x, 0) + c
        yield link_batch(forest, links)

    codes = save(classes.select("node", "vector").mapInArrow(code, ", ".join(["node long", *(f"{c} long" for c in columns)])), "codes")
    dealt = spread(codes)
    entries = dealt.select("node", *columns, F.explode(quantiser.tables.entries()).alias("entry"))
    by = ["entry", "low", "high"]
    shape = ", ".join(["entry long, low int, high int, own int, node long", *(f"{c} long" for c in columns)])
    met = in_blocks(entries, "entry", "node", quantiser.tables.heavy(dealt)).select(*by, "own", "node", *columns).mapInArrow(find, shape)
    full = met.join(classes.select("node", "n", "vector"), "node")
    return full.repartition(*by).sortWithinPartitions(*by).mapInArrow(rerank, LINKS)


def links_by_products(classes: DataFrame, cosine: float, block: int = EXACT_BLOCK) -> DataFrame:
    """All links among classes (node, n, vector, length), by length: each pair of blocks is compared once.

    A group holds two blocks of vectors; of their products a strip is held at a time.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, links = Forest(), {}
        for part, starts in group_runs(batches, ("length", "low", "high")):
            nodes, sizes, own, low, high = (part.column(c).to_numpy() for c in ("node", "n", "own", "low", "high"))
            vectors = vectors_of(part)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                a, b = a - int(starts[0]), b - int(starts[0])
                unit = unit_rows(vectors.slice(a, b - a), len(vectors[a]))
                same = low[a] == high[a]
                first = np.arange(b - a) if same else np.flatnonzero(own[a:b] == low[a])
                second = first if same else np.flatnonzero(own[a:b] == high[a])
                counts = np.zeros(b - a, np.int64)
                for at in range(0, len(first), 512):
                    strip = first[at : at + 512]
                    x, y = np.nonzero(unit[strip] @ unit[second].T >= cosine - 1e-9)
                    i, j = strip[x], second[y]
                    if same:
                        i, j = i[i < j], j[i < j]
                    good = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 50_000]], unit[j[k : k + 50_000]]) >= cosine for k in range(0, len(i), 50_000)]) if len(i) else np.zeros(0, bool)
                    i, j = i[good], j[good]
                    np.add.at(counts, i, sizes[a:b][j])
                    np.add.at(counts, j, sizes[a:b][i])
                    forest.link(nodes[a:b][i], nodes[a:b][j])
                for x, c in zip(nodes[a:b][counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
                    links[x] = links.get(x, 0) + c
        yield link_batch(forest, links)

    counts = classes.groupBy("length").count()
    by = ["length", "low", "high"]
    return in_blocks(classes.select("length", "node", "n", "vector"), "length", "node", counts, block).select(*by, "own", "node", "n", "vector").mapInArrow(compare, LINKS)


def embedding_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    Null vectors, zero vectors and those with null or non-finite components link with nothing, as do vectors of
    different lengths, each of which is searched by itself. Equal vectors are one class, whose members are linked with
    each other and counted in each other's links without being paired; a class of any size is one row. Repeated rows
    count as vectors of their own; a null key is never the least of a component that has another. An empty table gives
    an empty result; other columns are left out.
    """
    rows = pick(vectors, key=key, vector=vector)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    marked = rows.select("key", "vector", F.when(F.coalesce(finite, F.lit(False)), F.xxhash64("vector")).alias("node"))
    classes = save(marked.filter("node is not null").groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("n"), F.first("vector").alias("vector")).withColumn("length", F.size("vector")), "classes")
    common = classes.groupBy("length").count().orderBy(F.desc("count"), "length").limit(MAX_LENGTHS).collect()
    if not common:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    by_tables, parts = [], []
    for at, (length, count) in enumerate(common):
        if at and count < OWN_TABLES:
            break
        own = classes.filter(F.col("length") == length)
        sample = own.orderBy("node").limit(MAX_SAMPLE).select("vector").collect()
        quantiser = Quantiser(unit_rows(pa.array([list(r[0]) for r in sample], pa.list_(pa.float64())), length), cosine)
        if quantiser.boundary_recall >= BOUNDARY_RECALL:
            by_tables.append(length)
            parts.append(links_by_tables(own, quantiser, length, cosine))
    parts.append(links_by_products(classes.filter(~F.col("length").isin(by_tables)), cosine))
    found = parts[0]
    for d in parts[1:]:
        found = found.unionByName(d)
    found = save(found, "links")

    counts = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    firsts = classes.select("node", "first", "n")
    near = save(connected_components(found.filter("other is not null"), "node", "other"), "components").join(firsts.select("node", "first"), "node")
    heads = near.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = near.join(heads, "component").select("node", "component_id")
    known = firsts.join(counts, "node", "left").join(placed, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = marked.select("key", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))


#: All pairs and all that is reachable: for small tables.
OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components ON components.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
