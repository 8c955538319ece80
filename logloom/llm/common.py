"""Helpers shared by the training-data operators: tables, column picking, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds at a time, besides the Arrow batch that it came in.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name, under new names.

    Other columns of ``df`` may have any name, also one that differs from a picked one in case only;
    they are left out. Scans still read the picked columns alone.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in columns.items()])


def masked(stage: Callable[[DataFrame], DataFrame], df: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """``stage`` applied to ``df`` with all but the known columns under neutral names, which are then given back.

    So a stage may add what columns it likes: no column of ``df``, whatever its name, is taken for another.
    """
    names = [n if n in known else f"_other{i}" for i, n in enumerate(df.columns)]
    return stage(df.toDF(*names)).select(*names).toDF(*df.columns)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; on a local master without one, a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back: this cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``save`` wrote and that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chunk: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches into slices of about ``chunk`` characters of text, each with the texts as a list of str or None."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            value = column[i].as_py()
            texts.append(value)
            held += len(value) if value else 0
            if held >= chunk:
                yield batch.slice(start, i + 1 - start), texts
                start, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def bit_hash(*columns) -> F.Column:
    """A 64-bit hash of columns, for keys, samples and buckets (nulls count as values)."""
    return F.xxhash64(*columns)
