"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in up to 4 bits are found by cutting them into 3 segments: one of these differs
in one bit at most. Every segment is entered once for each of its bits with that bit left out; two segments that
differ in one bit or none then share an entry, and an equality join on the entries brings all candidates together,
to be verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import masked, pick, save, table, text_chunks
from .components import Segments, connected_components, spanning_links, spread

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one whole text, as a signed 64-bit number; zero for null and for texts without words."""
    found = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(found) - words] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def add_fingerprints(df: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` of every row, as a long."""
    rows = pick(df, **{f"key{i}": k for i, k in enumerate(keys)}, text=text)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([fingerprint(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "fingerprint"])

    schema = ", ".join([*(f"key{i} {kinds[f'key{i}']}" for i in range(len(keys))), "fingerprint long"])
    return rows.mapInArrow(run, schema).toDF(*keys, "fingerprint")


def segments(distance: int = 4) -> Segments:
    """Of this many segments, the fewest, one has a single differing bit at most."""
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return Segments([("fingerprint", low, high) for low, high in zip(edges[:-1], edges[1:], strict=True)])


def near_components(fingerprints: DataFrame, distance: int = 4) -> DataFrame:
    """(fingerprint, component) of the distinct fingerprints that link with any other at up to ``distance`` bits.

    The component is its least fingerprint as a signed number. Entries of many fingerprints are compared in blocks;
    tasks hand on spanning forests, so no pair within a group of copies is emitted.
    """
    tables = segments(distance)
    dealt = spread(fingerprints)
    entries = dealt.select("fingerprint", F.explode(tables.entries()).alias("entry"))

    def verify(part: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        bits = part.column("fingerprint").to_numpy()
        return np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)) <= distance

    links = spanning_links(entries, verify, (), "entry", "fingerprint", tables.heavy(dealt))
    return connected_components(links).toDF("fingerprint", "component")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4) -> DataFrame:
    """``key``, ``fingerprint`` (long) and ``component_id`` (least key reachable) of every document.

    Documents without words have fingerprint zero and link like any other; very long texts are read whole. Repeated rows
    keep a row each; null keys are never the least of a group that has another. Empty tables give empty results; other
    columns are left out.
    """
    marked = save(add_fingerprints(docs, (key,), text), "fingerprints")
    firsts = marked.groupBy("fingerprint").agg(F.min(key).alias("first"))
    near = save(near_components(firsts.select("fingerprint"), distance), "components").join(firsts, "fingerprint")
    heads = near.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = near.join(heads, "component").select("fingerprint", "component_id")
    placed = firsts.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(placed, "fingerprint").select(key, "fingerprint", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document, linked at 4 bits or fewer."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents, keep the one of least id (and text hash).

    A null id stands behind all others, so it is kept only where a group has no other. Rows are known by id and text hash;
    rows equal in both are copies, of which one stays. Null and empty texts are one group (fingerprint zero); very long
    texts are read whole; an empty table stays empty; other columns, whatever their names, keep their values.
    """
    del spark, sf_dir
    return masked(_one_of_each_group, docs, ("doc_id", "text"))


def _one_of_each_group(docs: DataFrame) -> DataFrame:
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    marked = save(add_fingerprints(keyed, ("doc_id", "_text")), "fingerprints")
    near = save(near_components(marked.select("fingerprint").distinct()), "components")
    heads = marked.join(near, "fingerprint", "left").groupBy(F.coalesce("component", "fingerprint").alias("component")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_text")).alias("head"))
    kept = heads.select("head.doc_id", "head._text").toDF("_id", "_hash").distinct()
    same = keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_text"] == kept["_hash"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text"])
