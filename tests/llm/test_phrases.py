"""Collocations against counts of all phrases, bounds that change no result, and edge cases."""

import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import phrases

DATA = "/root/testdata/sf0.001"


def brute(rows, min_count=30, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    by_lang = {}
    for lang, text in rows:
        if text is not None:
            by_lang.setdefault(lang or "und", []).append(text)
    for lang, texts in by_lang.items():
        f = Counter()
        for t in texts:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", t.translate(lower)):
                w = [x for x in re.split("[ \t]+", piece) if x]
                for m in range(1, 5):
                    f.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        inside = {}
        for p, c in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside.get(p[i : i + size], 0), c)
        found = []
        for p, a in candidates.items():
            if 100 * inside.get(p, 0) >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = ["The", "of", "and", "A", "é", "ß", "naïve", *[f"W{i}" for i in range(60)]]
    rows = [("en", None), ("en", ""), (None, " \t\n"), ("de", "one"), ("xx", "... , ;"), ("en", "in as much as " * 3000)]
    for i in range(400):
        w = [words[min(int(draw.expovariate(0.12)), len(words) - 1)] for _ in range(draw.randrange(120))]
        for _ in range(draw.randrange(3)):
            w[draw.randrange(len(w) + 1) :] += [["New York City", "by and large", "État, c'est moi", "x\ty  z."][draw.randrange(4)]]
        rows.append((("en", "de", None, "fr")[i % 4], draw.choice((" ", "\t", "  ")).join(w)))
    return rows + rows[-40:]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, g, 1, "p") for i, (g, t) in enumerate(corpus)], "doc_id long, text string, lang string, N int, Phrase string").repartition(5)


@pytest.mark.parametrize(("symbols", "chunk", "dense"), [(400_000, 12 << 20, 1 << 14), (400_000, 3_000, 20), (40, 3_000, 1), (3, 500, 50), (150, 20_000, 1 << 14)])
def test_phrases_by_brute_force(docs, corpus, monkeypatch, symbols, chunk, dense):
    """Whatever is known to all tasks, however texts are cut up and whichever tiles are dense."""
    monkeypatch.setattr(phrases, "DENSE", dense)
    want = brute(corpus)
    assert rows_of(phrases.mine_phrases(docs, max_symbols=symbols, chunk=chunk)) == want
    assert len(want) > 100


def test_first_rows_only(docs, corpus):
    assert rows_of(phrases.mine_phrases(docs, min_count=5, top=7)) == brute(corpus, 5, 7)


def test_empty_and_single(spark, docs):
    assert phrases.mine_phrases(docs.filter("false")).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([("a b c",)], "text string").selectExpr("text", "cast(null as string) as lang")).count() == 0


def test_tiles_count_pairs(monkeypatch):
    draw = np.random.default_rng(1)
    left, right = draw.geometric(0.003, 60_000), draw.geometric(0.01, 60_000)
    for dense in (1, 500, 1 << 30):
        monkeypatch.setattr(phrases, "DENSE", dense)
        got = {(a, b): c for a, b, c in zip(*(x.tolist() for x in phrases.count_pairs(left, right)), strict=True)}
        assert got == Counter(zip(left.tolist(), right.tolist(), strict=True))


def test_products_over_64_bits(spark):
    big = 4 * 10**12 + 1
    one = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    levels = [one([("a", "x", big + 2), ("a", "y", big + 5)]), one([("a", "x y", big)]), one([("a", "p q r", 1)]).filter("false"), one([("a", "p q r s", 1)]).filter("false")]
    (r,) = phrases.score_candidates(levels).collect()
    assert r.score == 2_000_000 * big // (2 * big + 7)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    data = str(Path(DATA).parent / "sf0.01")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.execute("SELECT lang, rank, phrase, a, l, r, n, score FROM (" + phrases.OP11_SQL + ")").fetchall())
    assert rows_of(phrases.op11_phrases(spark, data)) == want
    assert len(want) > 200


def test_driver_holds_few_bytes_a_symbol(spark):
    """The symbols of a level come to the driver as arrays, not as an object for each: under 100 bytes each at most."""
    n = 60_000
    counts = spark.range(n).selectExpr("if(id % 2 = 0, 'en', 'de') as lang", "concat('word', id) as phrase", "100 + id % 50 as n")
    phrases.most_frequent(counts.limit(10), n)
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    found, complete = phrases.most_frequent(counts, n)
    held, peak = pa.total_allocated_bytes() - before, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert complete
    assert len(found) > 0
    assert held + peak < 100 * n
