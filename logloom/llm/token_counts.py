"""Token counts of flat token files by a separator scan.

A flat file is a run of token ids, two or four bytes each, in which each document ends with the end-of-document id;
there is no index. Ranges of bytes of the files are scanned on their own for the separators, in numpy. A block's summary
is its number of tokens, its number of separators and its last one; prefix scans over these give every block its first
document number and the place where the document that is open at its start began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, default_vocabulary
from .common import pick, save, scratch_root, table, text_chunks

#: Tokens of a block.
BLOCK_TOKENS = 1 << 20
#: Tokens after which a task starts another file.
FILE_TOKENS = 1 << 25
#: Characters of text that are encoded at a time.
ENCODE_CHARS = 4 << 20
END = 50256


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or local path."""
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def token_type(vocabulary: str) -> np.dtype:
    """Two bytes where they hold every id of the vocabulary, else four."""
    return np.dtype("<u2" if len(codec(vocabulary).token_bytes) <= 1 << 16 else "<u4")


def write_token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write flat token files to a shared folder and return (path, document, key): which document of a file is whose.

    Each task writes its texts one after the other, each followed by ``end``. Every attempt of a task writes files of
    its own, and only those of the attempt that counts are in the result, so lost executors do no harm. Null and empty
    texts are documents of no tokens. The string of a special token inside a text is encoded as any other text, so that
    ``end`` stands for the end of a document alone.
    """
    path = vocabulary or default_vocabulary()
    kind = token_type(path)
    if not 0 <= end < 1 << 8 * kind.itemsize:
        raise ValueError("the end-of-document id does not fit in the files' tokens")
    root = folder or f"{scratch_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    rows = pick(docs, key=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (system, base) = codec(path), open_folder(root)
        name = lambda n: f"part-{TaskContext.get().partitionId():05d}-{n:04d}-{uuid.uuid4().hex[:12]}.bin"
        out, number, document, held = None, 0, 0, 0
        try:
            for batch, texts in text_chunks(batches, chunk=ENCODE_CHARS):
                if out is None or held >= file_tokens:
                    if out is not None:
                        out.close()
                    file, number, document, held = name(number), number + 1, 0, 0
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{file}")
                ids, ends = own.encode(texts, specials=False)
                tokens = np.insert(ids, ends, end).astype(kind)
                out.write(tokens.tobytes())
                held += len(tokens)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{file}"] * n), pa.array(range(document, document + n), pa.int64()), batch.column(0)], names=["path", "document", "key"])
                document += n
        finally:
            if out is not None:
                out.close()

    return save(rows.mapInArrow(run, f"path string, document long, key {rows.schema['key'].dataType.simpleString()}"), "token-documents")


def scan_separators(files: DataFrame, end: int = END, kind: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, block, n, ends): the tokens of each block of flat token files and the places of its separators, from 0.

    ``files`` has the ``path`` of each file, once. Only ranges of bytes are read, so files may be of any size.
    """
    width = np.dtype(kind).itemsize

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, local = open_folder(path)
                size = system.get_file_info(local).size
                if size % width:
                    raise ValueError(f"{path} ends within a token")
                n = -(-size // (block_tokens * width))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32())], names=["path", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, local = open_folder(path)
                with system.open_input_file(local) as f:
                    at = block * block_tokens * width
                    tokens = np.frombuffer(f.read_at(min(block_tokens * width, f.size() - at), at), kind)
                places = np.flatnonzero(tokens == end)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([places], pa.list_(pa.int64()))], names=["path", "block", "n", "ends"])

    blocks = files.select("path").mapInArrow(ranges, "path string, block int")
    return blocks.repartition("path", "block").mapInArrow(scan, "path string, block int, n long, ends array<long>")


def document_tokens(files: DataFrame, end: int = END, kind: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, document, first_token, n_tokens) of every document of flat token files, numbered in file order.

    ``n_tokens`` leaves the separator out. Tokens after a file's last separator are a document too. Two separators in
    a row enclose a document of no tokens. Empty files have no documents, and an empty table gives an empty result.
    """
    scanned = save(scan_separators(files, end, kind, block_tokens), "separators")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # summaries only: one short row for each block of a file
    sums = scanned.select("path", "block", "n", F.size("ends").alias("seps"), F.array_max("ends").alias("last"))
    sums = sums.withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "first_document": F.coalesce(F.sum("seps").over(before), F.lit(0)), "final": F.lead("block").over(order).isNull()})
    sums = sums.withColumn("open_from", F.coalesce(F.max(F.col("at") + F.col("last") + 1).over(before), F.lit(0)))
    placed = scanned.join(sums.select("path", "block", "at", "first_document", "open_from", "final"), ["path", "block"])
    ends = F.transform("ends", lambda e: e + F.col("at"))
    tail = F.when(F.col("final") & (F.coalesce(F.array_max(ends) + 1, F.col("open_from")) < F.col("at") + F.col("n")), F.array(F.col("at") + F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    ended = placed.select("path", "first_document", "open_from", F.concat(ends, tail).alias("ends"))
    starts = F.concat(F.array("open_from"), F.transform("ends", lambda e: e + 1))
    documents = ended.select("path", "first_document", F.posexplode(F.transform(F.arrays_zip(F.col("ends"), F.slice(starts, 1, F.size("ends")).alias("starts")), lambda z: F.struct(z["starts"].alias("start"), z["ends"].alias("end")))).alias("i", "d"))
    return documents.select("path", (F.col("first_document") + F.col("i")).alias("document"), F.col("d.start").alias("first_token"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """``key``, ``file``, ``document``, ``first_token`` and ``n_tokens`` of every row of ``docs``.

    Repeated rows and null keys have a row each; an empty table gives an empty result; other columns are left out.
    """
    written = write_token_files(docs, key, text, vocabulary, end)
    found = document_tokens(written.select("path").distinct(), end, token_type(vocabulary or default_vocabulary()).str)
    file = F.regexp_extract("path", r"([^/]*)-[^/-]*$", 1).alias("file")
    return written.join(found, ["path", "document"]).select(F.col("key").alias(key), file, "document", "first_token", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document of ``documents``, counted in flat token files that hold them all."""
    return count_tokens(table(spark, sf_dir, "documents"))
