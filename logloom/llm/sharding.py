"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots in each shard.

Every record key is hashed with every shard number; the shard with the least cost ``-ln(u) / weight`` takes the
record. A further shard only takes the records for which its own cost is the least, so no record moves between
the old shards. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, table

#: Rows of a shard that one task numbers at most, about.
ROWS_PER_BUCKET = 1 << 20


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Null keys are a key of their own.

    ``weights`` are positive; a shard gets rows in proportion to its weight.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    name = F.coalesce(key.cast("string"), F.lit("\x00null"))

    def cost(s: Column) -> Column:
        unit = (F.xxhash64(name, s["shard"]).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.ln(unit) / s["weight"]).alias("cost"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, cost))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (0, 1, ... within each shard) and, given ``grown_weights``, ``grown_shard``.

    Slots follow (bucket of the hash of key and ``order``, key, ``order``): a shard's rows are numbered in many buckets
    at once and a prefix sum over bucket counts joins them, so no task holds a whole shard, nor all rows of a key that
    differ in ``order``. Repeated rows get a slot each. An empty table gives an empty result; a null key is a key like
    any other. Columns of the added names, in any case, are replaced.
    """
    buckets = max(8, -(-df.count() // ROWS_PER_BUCKET))
    names = df.columns
    kept = [i for i, n in enumerate(names) if n.lower() not in ("shard", "slot", "grown_shard") or n == key or n in order]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in kept])
    own, *rest = (F.col(f"c{names.index(n)}") for n in (key, *order))
    grown = {} if grown_weights is None else {"grown_shard": rendezvous_shard(own, grown_weights)}
    placed = plain.withColumns({"shard": rendezvous_shard(own, weights), "bucket": F.pmod(F.xxhash64(F.lit("slot"), own, *rest), F.lit(buckets)), **grown})
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if len(weights) * buckets <= 200_000:  # rows of offsets, of 20 bytes each
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("shard", "bucket").orderBy(own, *rest)
    out = placed.withColumn("row", F.row_number().over(within)).join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("row") - 1)
    added = ["shard", "slot", *grown]
    return out.select(*[f"c{i}" for i in kept], *added).toDF(*[names[i] for i in kept], *added)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards by the ``key`` law; ``grown_shard`` is the place under 25 shards."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = assign_shards(sized, "doc_id", [1.0] * 24, [1.0] * 25, ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))
