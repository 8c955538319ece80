"""Set operations, sorts and limits (inventory K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.normalize import lookup

#: Order of priorities.
PRIORITY_RANK = {"P1": 1, "P2": 2, "P3": 3, "P4": 4}


def union_feed(tables: dict[str, DataFrame], columns: list[str], ts: str, key: str, each: int = 25, total: int = 100) -> DataFrame:
    """The newest rows of several tables in common columns (K1): each branch is cut down by itself first."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("feed"), *columns).orderBy(F.desc(ts), F.desc(key)).limit(each)
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc(ts), F.desc(key), "feed").limit(total)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def ranked_order(df: DataFrame, priority: str, then: list[Column]) -> DataFrame:
    """Rows in the order of their priority's rank, unknown ones last (K5)."""
    return df.orderBy(F.coalesce(lookup(PRIORITY_RANK, F.col(priority)), F.lit(9)), *then)


def repeatable_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same ``n`` rows every time, by order of a hash (K7)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)
