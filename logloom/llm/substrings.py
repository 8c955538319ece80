"""Substring deduplication with prefix-partitioned suffix trees over words.

1. Prefixes. Of the suffixes that start inside a window of 35 words, the one whose prefix of 8 words has the least hash
   is the window's anchor, so equal windows have equal anchors. All prefixes are counted first; those that more than
   ``HEAVY`` suffixes share are lengthened: a window is then anchored by another prefix, and by one of 20 words if it
   has heavy ones only.
2. Partitions. Neighbouring windows with the same anchor are one piece of text of 35 to 62 words, and pieces are dealt
   out by the anchor's prefix. So all suffixes that may share 35 words meet, and each word travels about four times,
   compressed with a dictionary of the table's own pieces.
3. Subtrees. A task sorts the suffixes of a prefix by their words and takes the longest common prefixes of neighbours,
   which are the depths of the suffix tree's internal nodes. The leaves under a node of depth 35 or more are the places
   of a maximal repeat. Words are compared as words, never by hashes. A subtree over the memory bound is built in parts.
4. The places go back to their texts, whose covered words are removed. A repeat that is longer than a piece is a chain of
   nodes in several subtrees; its words are covered by these together.

A place is (digest of the whole text, word number): exact copies of a text are one text here, and a text with copies
has all its windows repeated. Pieces that repeat within one task are settled there and send a single representative
through the shuffle, so a passage that a third of all documents share stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import CHUNK_BYTES, masked, pick, save, table, text_chunks

WINDOW = 35
#: Words of a prefix, and of one that is lengthened.
PREFIX, LONG_PREFIX = 8, 20
#: Suffixes of a prefix over which it is lengthened.
HEAVY = 20_000
#: The most frequent heavy prefixes, of 8 bytes each, that are lengthened; the order of prefixes changes no result.
MAX_HEAVY = 100_000
#: Suffixes of a subtree that is built at a time.
SUBTREE = 100_000
#: Bytes of pieces among which a task looks for repeats of its own before it starts anew.
GATHER_BYTES = 24 << 20
#: Copies of a text from which on its rows are dealt out by their own content instead of the text.
MANY_COPIES = 1_000
#: Pieces that the compression dictionary is made of at most, and their greatest length.
SAMPLE_PIECES, SAMPLE_BYTES = 4_000, 2_000
BASE = 0x9E3779B97F4A7C15
LONG = np.uint64(1 << 63)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_list(text: str | None) -> list[bytes]:
    """Runs of characters other than space and 0x09 to 0x0D."""
    return (text or "").encode("utf-8", "replace").split()


class Rolling:
    """Hashes of word runs of any start and length, from running sums modulo 2^64."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if n >= len(self.powers):
            size = max(2 * n, 1 << 14)
            step = np.full(size, BASE, np.uint64)
            step[0] = 1
            Rolling.powers = np.cumprod(step)
            step[1:] = pow(BASE, -1, 1 << 64)
            Rolling.inverses = np.cumprod(step)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.inverses[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    found = [np.lib.stride_tricks.sliding_window_view(values[at : min(at + 100_000, n) + width - 1], width).argmin(1) + at for at in range(0, n, 100_000)]
    return np.concatenate(found) + np.arange(n) - np.repeat(np.arange(0, n, 100_000), [min(100_000, n - at) for at in range(0, n, 100_000)])


def anchors(words: list[bytes], hashes: WordHashes, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hash of each anchor of a text and the first and last window that it is the anchor of.

    ``heavy`` holds the hashes of prefixes to be lengthened, in ascending order.
    """
    rolling = Rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
    short = rolling.of(np.arange(len(words) - PREFIX + 1), PREFIX) >> np.uint64(1)
    if len(heavy):
        near = np.minimum(np.searchsorted(heavy, short), len(heavy) - 1)
        short = np.where(heavy[near] == short, LONG, short)
    at = sliding_argmin(short, WINDOW - PREFIX + 1)
    prefix = short[at]
    lengthened = prefix == LONG
    if lengthened.any():
        long = rolling.of(np.arange(len(words) - LONG_PREFIX + 1), LONG_PREFIX) | LONG
        other = sliding_argmin(long, WINDOW - LONG_PREFIX + 1)
        at = np.where(lengthened, other, at)
        prefix = np.where(lengthened, long[other], prefix)
    low = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1]) | (prefix[1:] != prefix[:-1])) + 1))
    return prefix[low], low, np.append(low[1:] - 1, len(at) - 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Key and words of the texts that are long enough; of copies in a row of some millions of characters, the first."""
    seen: set[bytes] = set()
    for batch, texts in text_chunks(batches):
        if len(seen) > 200_000:
            seen.clear()
        for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            if key not in seen:
                seen.add(key)
                words = word_list(text)
                if len(words) >= WINDOW:
                    yield key, words


def _count_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, n): how many anchors of a task have each prefix, counted within some millions of them."""
    hashes, none = WordHashes(), np.zeros(0, np.uint64)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        prefix, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(n, pa.int64())], names=["prefix", "n"])

    held, n = [], 0
    for _, words in _texts(batches):
        held.append(anchors(words, hashes, none)[0])
        n += len(held[-1])
        if n > 1_000_000:
            yield counted(held)
            held, n = [], 0
    if held:
        yield counted(held)


def _sample_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    draw = np.random.default_rng(1)
    for n, (_, words) in enumerate(_texts(batches)):
        if n * 4 > SAMPLE_PIECES:
            return
        at = draw.integers(0, len(words) - WINDOW + 1, 4).tolist()
        found = [b" ".join(words[i : i + 48]) for i in at]
        yield pa.RecordBatch.from_arrays([pa.array([x for x in found if len(x) <= SAMPLE_BYTES], pa.binary())], names=["piece"])


def piece_dictionary(rows: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample of (key, text); which one it is changes no result."""
    sample = [bytes(r[0]) for r in rows.mapInArrow(_sample_pieces, "piece binary").limit(SAMPLE_PIECES).collect()]
    try:
        return zstandard.train_dictionary(1 << 16, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few pieces to learn from
        return b" ".join(sample)[: 1 << 16]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


PIECE = pa.schema([("prefix", pa.int64()), ("key", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("piece", pa.binary())])


def piece_rows(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Pieces as (prefix, key, low, high, piece): text and numbers of the first and last window, and the words,
    compressed.

    Of pieces that are equal within the task the first goes on; the windows of all of them are known to repeat, and
    are given once more without ``prefix`` and ``piece``.
    """
    hashes, pack = WordHashes(), zstandard.ZstdCompressor(level=1, dict_data=_dictionary(dictionary)).compress
    seen: dict[bytes, tuple | None] = {}
    rows: list[tuple] = []
    held = 0
    for key, words in _texts(batches):
        prefix, low, high = anchors(words, hashes, heavy)
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        for p, a, b, x, y in zip(prefix.view(np.int64).tolist(), low.tolist(), high.tolist(), starts[low].tolist(), (ends[high + WINDOW - 1] - 1).tolist(), strict=True):
            piece = line[x:y]
            if piece not in seen:
                seen[piece] = (None, key, a, b, None)
                rows.append((p, key, a, b, pack(piece)))
                held += y - x
            else:
                if first := seen[piece]:
                    rows.append(first)
                    seen[piece] = None
                if rows and rows[-1][:2] == (None, key) and rows[-1][3] + 1 == a:  # goes on from the piece before
                    a = rows.pop()[2]
                rows.append((None, key, a, b, None))
        if len(rows) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE.types, strict=True)], schema=PIECE)
            rows = []
        if held > GATHER_BYTES:
            seen, held = {}, 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE.types, strict=True)], schema=PIECE)


def subtree_leaves(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Depth of the deepest internal node above each suffix; suffixes of different trees share nothing.

    ``words`` are numbers of at least 1, ``starts`` the suffixes' places there, ``lengths`` where they end. In sorted
    order the depth of the lowest node above two neighbours is the length of their common prefix.
    """
    width = int(lengths.max(initial=0))
    padded = np.concatenate((words, np.zeros(width, words.dtype)))
    rows = np.zeros((len(starts), width + 1), ">u4")
    rows[:, 0] = tree
    rows[:, 1:] = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
    rows[:, 1:][np.arange(width) >= lengths[:, None]] = 0
    order = np.argsort(rows.view(f"V{4 * (width + 1)}")[:, 0], kind="stable")
    rows = rows[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(1), differs.argmax(1) - 1, width)
    common = np.minimum(common, np.minimum(lengths[order][1:], lengths[order][:-1]))
    depth = np.empty(len(starts), np.int64)
    depth[order] = np.maximum(np.concatenate((common, [0])), np.concatenate(([0], common))).clip(0)
    return depth


def grow_subtrees(rows: list[tuple[int, bytes, int, int, bytes]]) -> list[tuple[bytes, int, int]]:
    """(key, low, high): runs of windows that repeat among the pieces of whole prefixes, given in order of prefix."""
    number: dict[bytes, int] = {}
    cut = [piece.split(b" ") for *_, piece in rows]
    for words in cut:
        for w in words:
            number.setdefault(w, len(number) + 1)
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = np.fromiter((number[w] for words in cut for w in words), np.uint32, int(sizes.sum()))
    counts = sizes - (WINDOW - 1)  # suffixes of each piece that hold a window
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begin[row] + within
    tree = np.unique(np.fromiter((r[0] for r in rows), np.int64, len(rows)), return_inverse=True)[1][row]
    lengths = (begin + sizes)[row] - starts
    repeated = np.zeros(len(row), bool)
    if len(row) <= 2 * SUBTREE:
        repeated = subtree_leaves(flat, starts, lengths, tree) >= WINDOW
    else:  # suffixes with equal windows fall in the same part
        parts = -(-len(row) // SUBTREE)
        part = Rolling(flat.astype(np.uint64)).of(starts, WINDOW) % np.uint64(parts)
        for p in range(parts):
            own = np.flatnonzero(part == p)
            if len(own):
                repeated[own] = subtree_leaves(flat, starts[own], lengths[own], tree[own]) >= WINDOW
    # runs of neighbouring windows within a piece
    good = np.flatnonzero(repeated)
    if not len(good):
        return []
    new = np.concatenate(([True], (row[good[1:]] != row[good[:-1]]) | (good[1:] != good[:-1] + 1)))
    first, last = good[new], good[np.concatenate((new[1:], [True]))]
    return [(rows[r][1], rows[r][2] + a, rows[r][2] + b) for r, a, b in zip(row[first].tolist(), within[first].tolist(), within[last].tolist(), strict=True)]


RUN = pa.schema([("key", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])


def repeats_of_prefixes(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows, from pieces sorted by (prefix, piece, key, low).

    Equal pieces, which other tasks have sent as well, follow each other: one of them stands for all, and the windows of
    the others are known to repeat. So what is held of a prefix are its distinct pieces, however many texts share them.
    """

    def runs(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), RUN.types, strict=True)], schema=RUN)

    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
    ready: list[tuple] = []  # pieces of whole prefixes
    group: list[tuple] = []  # those of the prefix that is being read
    windows, first, place, alone = 0, None, None, True
    for batch in batches:
        known = batch.filter(pc.is_null(batch.column(0)))
        if known.num_rows:
            yield pa.RecordBatch.from_arrays(known.columns[1:4], schema=RUN)
        fresh = batch.filter(pc.is_valid(batch.column(0)))
        again: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in fresh.columns), strict=True):
            if first is not None and row[0] == first[0] and row[4] == first[4]:
                if row[1:3] != place:  # else a copy of the text in another task
                    if alone:
                        again.append(first[1:4])
                        alone = False
                    again.append(row[1:4])
                    place = row[1:3]
                continue
            if first is not None and row[0] != first[0]:
                if len(group) > 1:
                    ready += [(*r[:4], unpack(r[4])) for r in group]
                    windows += sum(r[3] - r[2] + 1 for r in group)
                group = []
                if windows >= SUBTREE:
                    if found := grow_subtrees(ready):
                        yield runs(found)
                    ready, windows = [], 0
            group.append(row)
            first, place, alone = row, row[1:3], True
        if again:
            yield runs(again)
    if len(group) > 1:
        ready += [(*r[:4], unpack(r[4])) for r in group]
    if ready and (found := grow_subtrees(ready)):
        yield runs(found)


def text_key(text: F.Column) -> F.Column:
    """The text's digest of 16 bytes; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeated_runs(docs: DataFrame, text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(key, low, high): text digest and first and last word number of runs of window starts that repeat elsewhere.

    A text with exact copies shows only the repeats it shares with itself and with other texts.
    """
    rows = pick(docs, text=text).filter(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")
    counts = rows.mapInArrow(_count_prefixes, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    # at most MAX_HEAVY numbers reach the driver
    most = counts.filter(F.col("n") > heavy).orderBy(F.desc("n"), "prefix").limit(MAX_HEAVY).collect()
    lengthen = np.sort(np.array([r.prefix for r in most], np.int64).view(np.uint64))
    dictionary = piece_dictionary(rows)
    pieces = rows.mapInArrow(lambda batches: piece_rows(batches, lengthen, dictionary), "prefix long, key binary, low int, high int, piece binary")
    dealt = pieces.repartition(F.coalesce("prefix", F.xxhash64("key", "low"))).sortWithinPartitions("prefix", "piece", "key", "low")
    return dealt.mapInArrow(lambda batches: repeats_of_prefixes(batches, dictionary), "key binary, low int, high int")


def pack_texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches whose texts are compressed one by one, so that a shuffle moves less; null stays null."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch, texts in text_chunks(batches, text):
        packed = pa.array([None if t is None else pack(t.encode("utf-8")) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([packed if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)


def unpack_texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches with the texts that were packed, some millions of characters at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            value = column[i].as_py()
            texts.append(None if value is None else unpack(value).decode("utf-8"))
            held += len(texts[-1] or "")
            if held >= CHUNK_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), texts
                start, held, texts = i + 1, 0, []


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (the kept words joined by one space).

    Every word that a repeated window of 35 words covers is removed, at all its places; windows are judged on the
    input. Null and empty texts have no words and an empty ``kept_text``. Repeated rows count as places of their own.
    Very long texts are read whole. Texts of fewer than 35 words lose nothing. Columns of the added names, in any case,
    are replaced; an empty table stays empty.
    """
    names = docs.columns
    at = names.index(text)
    kept = [i for i, n in enumerate(names) if n.lower() not in ("n_words", "n_removed", "kept_text")]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in sorted({*kept, at})]).withColumn("key", text_key(F.col(f"c{at}")))
    runs = save(repeated_runs(docs, text), "repeats").groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    copies = save(plain.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    # a text with copies is removed as a whole, so its copies need no list each
    known = copies.select("key", F.lit(True).alias("copied")).join(runs, "key", "full")
    known = known.select("key", "copied", F.when(F.col("copied").isNull(), F.col("runs")).alias("runs"))
    # rows of a text with many copies are known as such at once, and dealt out by their other columns
    many = copies.filter(F.col("copies") >= MANY_COPIES).select("key", F.lit(True).alias("many"))
    if many.count() <= 200_000:  # 17 bytes each
        many = F.broadcast(many)
    own = [f.name for f in plain.schema.fields if isinstance(f.dataType, AtomicType)]
    spread = F.unhex(F.md5(F.concat(F.hex("key"), F.xxhash64(*own).cast("string")).cast("binary")))
    types = ", ".join(f"{f.name} {'binary' if f.name == f'c{at}' else f.dataType.simpleString()}" for f in plain.schema.fields)
    packed = plain.mapInArrow(lambda batches: pack_texts(batches, f"c{at}"), types)
    marked = packed.join(many, "key", "left").withColumn("key", F.when(F.col("many"), spread).otherwise(F.col("key")))
    joined = marked.join(known, "key", "left").drop("key").withColumn("copied", F.coalesce("many", "copied")).drop("many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpack_texts(batches, f"c{at}"):
            copied, found = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("copied", "runs"))
            counts, removed, left = [], [], []
            for i, text in enumerate(texts):
                words = word_list(text)
                n = len(words)
                if n >= WINDOW and copied[i]:
                    words = []
                elif n >= WINDOW and found[i]:
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, [r["low"] for r in found[i]], 1)
                    np.add.at(change, [r["high"] + WINDOW for r in found[i]], -1)
                    words = [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not c]
                counts.append(n)
                removed.append(n - len(words))
                left.append(b" ".join(words).decode("utf-8"))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(batch.schema.get_field_index(f"c{i}")) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())], names=[*(f"c{i}" for i in kept), "n_words", "n_removed", "kept_text"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.select(*[f"c{i}" for i in kept]).schema.fields), "n_words long, n_removed long, kept_text string"])
    return joined.mapInArrow(run, schema).toDF(*[names[i] for i in kept], "n_words", "n_removed", "kept_text")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and the digest of those kept."""
    out = remove_repeats(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), cut AS (
  SELECT r, list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' ')) AS s FROM texts WHERE len(w) >= 35
), windows AS (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS j FROM cut),
repeated AS (SELECT r, j FROM (SELECT r, j, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM texts),
covered AS (
  SELECT words.r, words.j, word, count(repeated.j) OVER (PARTITION BY words.r ORDER BY words.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words LEFT JOIN repeated ON words.r = repeated.r AND words.j = repeated.j
), kept AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


def drop_repeated_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: remove repeated passages from the texts; texts without any stay as they are, ``n_chars`` follows.

    Null and empty texts, very long ones, repeated rows and empty tables are as in ``remove_repeats``; other columns,
    whatever their names, keep their values.
    """
    del spark, sf_dir

    def stage(d: DataFrame) -> DataFrame:
        out = remove_repeats(d)
        return out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))

    return masked(stage, docs, ("text", "n_chars"))
