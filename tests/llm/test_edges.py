"""Split documents, languages of long texts only, near copies without ids, empty tables."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logloom.llm import decontaminate, langid, simhash, substrings

WORDS = [f"w{i}" for i in range(4000)]


def test_split_documents_equal_sql(spark):
    """Rows of one id hold an item together, however short each is, as the registered SQL has it."""
    w = WORDS[:40]
    items = pd.DataFrame({"item_id": [1, 2], "text": [" ".join(w), " ".join(WORDS[100:160])]})
    docs = pd.DataFrame({"doc_id": [5, 5, 6, 7, 7, 7, 8], "text": [" ".join(w[:22]), " ".join(w[18:]), " ".join(w[:22]), *(" ".join(WORDS[100 + i : 126 + i]) for i in (0, 17, 34)), " ".join(w)]})
    con = duckdb.connect()
    con.register("benchmark", items)
    con.register("documents", docs)
    want = {tuple(r) for r in con.execute(decontaminate.OP1_SQL).fetchall()}
    found = decontaminate.contained_items(spark.createDataFrame(docs), spark.createDataFrame(items)).collect()
    assert {(r.doc_id, r.item_id, round(r.containment, 6)) for r in found} == want
    assert {k for k, *_ in want} == {5, 7, 8}


def test_stage_with_split_and_equal_texts(spark, tmp_path):
    w = WORDS[:40]
    spark.createDataFrame([(1, " ".join(w))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w)), (None, "other " * 9), (3, None), (3, "")], "doc_id long, text string")
    kept = decontaminate.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "None"]


def test_languages_of_long_texts_are_learned(spark):
    draw = random.Random(2)
    speech = {"en": ["the", "of", "and", "that", "with"], "de": ["der", "und", "nicht", "ist", "ein"], "fr": ["le", "est", "une", "avec", "où"]}
    some = lambda g, n: " ".join(draw.choices(speech[g], k=n))
    rows = [(i, some(g, 2000 if g == "fr" else 30), g) for i, g in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, lambda c: c >= 0, max_bytes=30_000)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs, model).collect()}
    assert np.mean([got[i] == g for i, _, g in rows]) > 0.95
    # one text longer than all of the room
    one = spark.createDataFrame([(1, "é" * 500_000, "xx"), (2, "a b c " * 9, "yy")], "doc_id long, text string, lang string")
    seen = []
    plain, langid.ByteGRU.fit = langid.ByteGRU.fit, lambda self, texts, y: seen.append(sum(map(len, texts))) or self
    try:
        assert langid.fit_languages(one, lambda c: c >= 0, max_bytes=10_000).languages == ["xx", "yy"]
        assert langid.fit_languages(one, lambda c: c >= 0).languages == ["xx", "yy"]
    finally:
        langid.ByteGRU.fit = plain
    assert seen[0] <= 10_000
    assert 100_000 < seen[1] <= langid.MAX_BYTES
    assert langid.fit_languages(one.filter("false"), lambda c: c >= 0) is None
    assert langid.predict_languages(one.filter("false"), model).count() == 0


def test_near_copies_prefer_rows_with_an_id(spark):
    t = " ".join(WORDS[:90])
    rows = [(None, t), (2, t), (1, t), (None, "alone here " + " ".join(WORDS[200:260])), (None, "alone here " + " ".join(WORDS[200:260]))]
    kept = simhash.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"]


def test_pieces_of_many_texts_are_held_once(spark, monkeypatch):
    """A passage that every text holds is one piece of its prefix, though each task sends its own."""
    draw = random.Random(3)
    passage = " ".join(draw.choices(WORDS, k=50))
    docs = spark.createDataFrame([(i, f"{' '.join(draw.choices(WORDS, k=40))} {passage} {i}") for i in range(64)], "doc_id long, text string").repartition(16)
    groups = []
    plain = substrings.grow_subtrees
    rows = substrings.pick(docs, text="text").select(substrings.text_key(F.col("text")).alias("key"), "text")
    none = np.zeros(0, np.uint64)
    pieces = rows.mapInArrow(lambda b: substrings.piece_rows(b, none, b""), "prefix long, key binary, low int, high int, piece binary").repartition(1).sortWithinPartitions("prefix", "piece", "key", "low").toArrow()
    monkeypatch.setattr(substrings, "grow_subtrees", lambda rows: groups.append([r[4] for r in rows]) or plain(rows))
    found = [r for batch in substrings.repeats_of_prefixes(iter(pieces.to_batches(max_chunksize=100)), b"") for r in batch.to_pylist()]
    covered = {}
    for r in found:
        covered.setdefault(r["key"], set()).update(range(r["low"], r["high"] + 1))
    assert len(covered) == 64
    assert all(len(x) == 50 - substrings.WINDOW + 1 for x in covered.values())
    inner = [x for g in groups for x in g if x.decode() in passage]
    assert len(inner) == len(set(inner))
