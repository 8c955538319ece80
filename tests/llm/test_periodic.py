"""Periodic runs against a search of every lag, and their defined edge cases."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from logloom.llm import periodic

DATA = "/root/testdata/sf0.001"


def brute_runs(w):
    """Every longest stretch of every lag, kept if no smaller lag holds over all of it."""
    n, runs = len(w), []
    for q in range(1, n // 3 + 1):
        at = 0
        while at < n - q:
            if w[at] != w[at + q]:
                at += 1
                continue
            end = at
            while end < n - q and w[end] == w[end + q]:
                end += 1
            start, stop = at, end + q
            if stop - start >= max(24, 3 * q) and not any(all(w[i] == w[i + d] for i in range(start, stop - d)) for d in range(1, q)):
                runs.append((start, stop - start, q))
            at = end
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(a + q <= i < a + n for a, n, q in runs))


def numbers(w):
    seen = {}
    return np.array([seen.setdefault(x, len(seen) + 1) for x in w], np.uint64)


def texts():
    draw = random.Random(12)
    some = lambda n, k=400: [f"w{draw.randrange(k)}" for _ in range(n)]
    for k in (1, 2, 3, 5):
        yield from (some(draw.randrange(1, 150), k) for _ in range(60))
    for _ in range(80):  # repeated blocks with errors, side by side and within each other
        w = some(draw.randrange(60))
        for _ in range(draw.randrange(1, 4)):
            block = some(draw.randrange(1, 40), draw.choice((2, 3, 400)))
            w += (block * draw.randrange(2, 9))[: draw.randrange(1, 400)] + some(draw.randrange(20))
        for _ in range(draw.randrange(3)):
            w[draw.randrange(len(w))] = "error" + str(draw.randrange(2))
        yield w
    a, b = ["a"], ["a", "b"]
    for _ in range(9):  # Fibonacci words hold runs of many periods
        a, b = b, b + a
    yield b[:140]
    yield ["x"] * 23
    yield ["x"] * 24
    yield (["a"] * 30 + ["b"]) * 4
    yield (["a", "b"] * 20 + ["c"]) * 5


def test_runs_are_those_of_every_lag():
    found = 0
    for w in texts():
        want = brute_runs(w)
        assert periodic.find_runs(numbers(w)) == want, w
        found += len(want)
    assert found > 120


@pytest.mark.parametrize("block", [1, 2, 300, 3000])
def test_long_repeats_take_time_in_proportion(block):
    draw = np.random.default_rng(1)
    w = np.tile(draw.integers(1, 1 << 40, block).astype(np.uint64), 200_000 // block)
    began = time.time()
    assert periodic.find_runs(w) == [(0, len(w), block)]
    assert time.time() - began < 20


def test_many_lengths_of_one_word_take_bounded_time():
    draw = np.random.default_rng(2)
    w = np.concatenate([np.r_[np.ones(draw.integers(20, 900), np.uint64), [np.uint64(i + 2)]] for i in range(60)])
    began = time.time()
    runs = periodic.find_runs(w)
    assert time.time() - began < 20
    assert all(q == 1 for _, _, q in runs)
    assert len(runs) > 50


def test_edge_cases(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names, an empty table."""
    tie = " ".join(["a"] * 30 + [f"u{i}" for i in range(9)] + ["b"] * 30)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "x y " * 100_000), (6, tie), (6, tie), (None, "z " * 24)]
    docs = spark.createDataFrame([(k, t, "r", 1) for k, t in rows], "doc_id long, text string, Runs string, `DOC ID` int")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed_text) for r in periodic.periodic_runs(docs).collect()), key=str)
    w = tie.split()
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [], "one"), (5, [(0, 200_000, 2)], "x y"), (None, [(0, 24, 1)], "z")]
    want += 2 * [(6, [(0, 30, 1), (39, 30, 1)], collapsed(w, [(0, 30, 1), (39, 30, 1)]))]
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(docs.filter("false")).count() == 0


def test_query_by_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op12_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for doc_id, text in docs:
        w = (text or "").encode().split()
        w = [x.decode() for x in w]
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if n > 1500 and not planted % 7:  # brute force takes the square of a text's length
            continue
        runs = brute_runs(w) if n <= 1500 else periodic.find_runs(numbers(w))
        planted += bool(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{x},{y},{z}\n" for x, y, z in runs)), digest(collapsed(w, runs)))
        assert got[doc_id] == want, doc_id
    assert planted > 10
