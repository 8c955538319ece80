"""Periodic runs of words by seeds that are extended along diagonals.

A run is a longest stretch of words that repeats with a smallest period q, of 24 words and three periods at least. Along
the diagonal of lag q it overlaps itself in at least max(24 - q, 2 q) words.

1. Seeds. Lags are taken in classes of a power of two. The least overlap of a class holds a whole k-gram of half its
   length at one of every k + 1 words, so those anchors are looked up in the index of all k-grams of the document. An
   anchor meets at most a class of lags, so a document has some n pairs in each class, however it repeats.
2. Diagonals. A pair of an anchor and its occurrence at lag q, next to which q words agree by their hashes, is extended
   word by word both ways. A table keeps how far each lag has been covered, and pairs before that are passed over.
3. Pairs inside a run of a smaller period are multiples of it and passed over as well, and so are stretches that such a
   run covers.

Only words that occur in k-grams which repeat are taken on to longer k-grams; most documents end at the first class.
Documents are independent: a task works on a document at a time, with arrays in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, text_chunks
from .substrings import Rolling, word_list

MIN_WORDS, MIN_PERIODS = 24, 3
#: Greatest lag of the first class, whose overlap is at least 16 words.
FIRST_LAGS = 8


def lag_classes(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(least lag, greatest lag, k, step of the anchors) of each class of a document of n words."""
    low, high = 1, FIRST_LAGS
    while low * MIN_PERIODS <= n and n >= MIN_WORDS:
        overlap = max(MIN_WORDS - high, (MIN_PERIODS - 1) * low)
        k = overlap // 2
        yield low, min(high, n // MIN_PERIODS), k, overlap - k + 1
        low, high = high + 1, 2 * high


def match_end(w: np.ndarray, i: int, j: int, way: int) -> int:
    """Number of equal words from i and j on (way 1), or before them (way -1); j is the greater."""
    most = len(w) - j if way > 0 else i
    done, size = 0, 32
    while done < most:
        size = min(2 * size, most - done)
        a, b = (w[i + done : i + done + size], w[j + done : j + done + size]) if way > 0 else (w[i - done - size : i - done][::-1], w[j - done - size : j - done][::-1])
        differs = a != b
        if differs.any():
            return done + int(differs.argmax())
        done += size
    return most


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document, by start and period. ``w`` are the words as hashes or numbers."""
    n = len(w)
    runs: list[tuple[int, int, int]] = []
    far = np.zeros(n + 1, np.int64)  # of the runs so far that cover a word, the furthest end
    rolling, live = None, np.arange(n)
    for low, high, k, step in lag_classes(n):
        live = live[live <= n - k]
        if not len(live):
            break
        rolling = rolling or Rolling(w)
        grams = rolling.of(live, k)
        order = np.argsort(grams, kind="stable")  # by k-gram, then by place
        new = np.concatenate(([True], grams[order][1:] != grams[order][:-1]))
        number = np.cumsum(new) - 1
        size = np.bincount(number)[number]
        index = (number * (n + 1) + live[order])[size > 1]
        live = np.sort(live[order[size > 1]])
        found: list[tuple[int, int, int]] = []
        anchors = index[index % (n + 1) % step == 0]
        first, last = np.searchsorted(index, anchors + low), np.searchsorted(index, anchors + high, side="right")
        # an entry of the next k-gram is no occurrence
        last = np.minimum(last, np.searchsorted(index, (anchors // (n + 1) + 1) * (n + 1)))
        first = np.minimum(first, last)
        count = last - first
        i = np.repeat(anchors % (n + 1), count)
        j = index[np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)] % (n + 1)
        q = j - i
        # two periods agree, so a whole one does after the anchor or before it
        after, before = j + q <= n, i >= q
        good = np.zeros(len(i), bool)
        good[after] = rolling.of(i[after], q[after]) == rolling.of(j[after], q[after])
        good[before] |= rolling.of(i[before] - q[before], q[before]) == rolling.of(i[before], q[before])
        good &= far[i] < j + k
        i, q = i[good], q[good]
        by_lag = np.lexsort((i, q))
        covered: dict[int, int] = {}
        for at, lag in zip(i[by_lag].tolist(), q[by_lag].tolist(), strict=True):
            if at < covered.get(lag, 0) or far[at] >= at + lag + k:
                continue
            start = at - match_end(w, at, at + lag, -1)
            end = at + match_end(w, at, at + lag, 1) + lag
            covered[lag] = end - lag
            if end - start >= max(MIN_WORDS, MIN_PERIODS * lag) and far[start] < end:
                found.append((start, end - start, lag))
                if lag <= k:  # its multiples in this class are passed over at once
                    far[start:end] = np.maximum(far[start:end], end)
        for start, length, _ in found:
            far[start : start + length] = np.maximum(far[start : start + length], start + length)
        runs += found
    return sorted(runs, key=lambda r: (r[0], r[2]))


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed_text`` (the words left
    once each run is cut down to its first period, joined by one space) of every row.

    Null texts, and texts without words, have no runs and an empty ``collapsed_text``. Texts are read whole; the memory of a
    task goes with its longest text. Rows are independent: repeated rows, null keys, ties and empty tables need no care;
    other columns, whatever their names, are left out.
    """
    rows = pick(docs, key=key, text=text)
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            number: dict[bytes, int] = {}  # words as numbers: equal exactly if the words are
            runs, left = [], []
            for t in texts:
                words = word_list(t)
                if len(words) < MIN_WORDS:
                    found = []
                else:
                    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.uint64, len(words))
                    found = find_runs(ids * np.uint64(0x9E3779B97F4A7C15))  # an odd factor keeps them distinct
                runs.append([{"start": a, "length": n, "period": p} for a, n, p in found])
                if found:
                    words = [w for w, gone in zip(words, dropped_words(len(words), found).tolist(), strict=True) if not gone]
                left.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, shape), pa.array(left, pa.string())], names=["key", "runs", "collapsed_text"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed_text string").withColumnRenamed("key", key)


def planted_text(doc_id: Column, text: Column) -> Column:
    """The contract's input: of a tenth of the ids, the words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.nullif(F.size(words).cast("long"), F.lit(0))
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    rest = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), rest), " ")).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document: their number, the one of greatest exponent, digests of all and of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    # of equal exponents the run of least start, then period, comes first in order
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), better)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
