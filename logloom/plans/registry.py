"""All registered queries and their SQL.

A query module declares its queries with ``query(name, sql)``. Results are brought to a form that engines agree on:
times as microseconds since 1970, doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.fixtures import us_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    def form(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("timestamp_ntz", "timestamp"):
            return us_of(c.cast("timestamp_ntz")).alias(name)
        return F.round(c, 6).alias(name) if kind in ("double", "float") else c

    return df.select(*[form(n, k) for n, k in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def load_all() -> None:
    """Import the query modules."""
    from logloom.plans import aggregates, case_plans, evidence_plans, features, investigations, joins_plans, stream_plans, windows_plans  # noqa: F401
