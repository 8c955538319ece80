"""Document quality by Bradley-Terry pairwise ranking.

A linear score is learned from preference pairs (a good and a bad labelled document) by logistic loss on the
difference of their features. The quantile of the labelled scores at the share of bad labels becomes the threshold;
scores are put on a 0 to 1 scale on which that threshold is ``THRESHOLD``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import masked, pick, table, text_chunks

#: Labelled documents that the fit uses at most: those with the least hash of their id.
MAX_LABELLED = 6_000
#: Preference pairs that the fit uses at most, drawn from these documents.
MAX_PAIRS = 60_000
#: The score at and above which a document is accepted.
THRESHOLD = 0.3

#: Byte classes: each is a feature, as its share of the text's bytes.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,", b"!?", b"|", b"#%$&*", b"@/:", b"-_=+~^", b"'\"()[]{}<>;\\`")
FEATURES = len(CLASSES) + 13


def _class_table() -> np.ndarray:
    kinds = np.full(256, len(CLASSES) + 1, np.uint8)  # other control bytes
    kinds[128:] = len(CLASSES)
    for k, members in enumerate(CLASSES):
        kinds[list(members)] = k
    return kinds


KINDS = _class_table()


def features(text: str | None) -> np.ndarray:
    """The features of one whole text; all zero but for the last, which is 1, if it has no word."""
    out = np.zeros(FEATURES)
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        out[-1] = 1.0
        return out
    shares = np.bincount(KINDS[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 2) / len(data)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    at = len(CLASSES)
    out[: at + 2] = shares
    out[at + 2] = np.log1p(n)
    out[at + 3] = lengths.mean() / 10
    out[at + 4] = min(lengths.std() / 10, 5)
    out[at + 5] = len(counts) / n**0.75  # distinct words grow more slowly than words
    out[at + 6] = max(counts.values()) / n
    out[at + 7] = sum(map(bytes.__eq__, words, words[1:])) / n
    out[at + 8] = 1 - len(set(lines)) / len(lines)
    out[at + 9] = min(n / len(lines), 500) / 100
    out[at + 10] = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,") / n
    out[at + 11] = np.log1p(len(lines))
    return out


def score_features(df: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    rows = pick(df, **{f"key{i}": k for i, k in enumerate(keys)}, text=text)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            found = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([features(t) for t in texts])), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "features"])

    schema = ", ".join([*(f"key{i} {kinds[f'key{i}']}" for i in range(len(keys))), "features array<double>"])
    return rows.mapInArrow(run, schema).toDF(*keys, "features")


class PairwiseRanker:
    """Weights over standardised features, and the scale of the scores."""

    def __init__(self):
        self.mean, self.scale, self.weights, self.cut = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the learned cut. Without preference pairs every score is 0.5."""
        if not self.weights.any():
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut, -30, 30)) * (1 - THRESHOLD) / THRESHOLD)

    def fit(self, x: np.ndarray, good: np.ndarray, seed: int = 7) -> PairwiseRanker:
        """Newton steps on the ridge-penalised logistic loss of feature differences."""
        up, down = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(up) or not len(down):
            return self
        self.mean, spread = x.mean(0), x.std(0)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        draw = np.random.default_rng(seed)
        n = min(MAX_PAIRS, 40 * len(x))
        d = z[draw.choice(up, n)] - z[draw.choice(down, n)]
        w, ridge = np.zeros(FEATURES), 1e-3 * n
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the wrong order
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(FEATURES), d.T @ p - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        raw = np.sort(self.raw(x))
        at = len(down) / len(x) * (len(x) - 1)
        # the quantile lies between two labelled scores; the cut is their middle
        self.cut = float((raw[int(at)] + raw[min(int(at) + 1, len(x) - 1)]) / 2)
        return self


def fit_ranker(docs: DataFrame, labels: DataFrame, fold_filter, max_labelled: int = MAX_LABELLED) -> PairwiseRanker:
    """Fit on the labelled rows (doc_id, quality) for which ``fold_filter(doc_id column)`` holds.

    Rows with a null id or label, or a label other than 0 and 1, do not count. At most ``max_labelled`` of them are
    used, by order of their id's hash, so the part that reaches the driver has a fixed size.
    """
    usable = pick(labels, doc_id="doc_id", quality="quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & fold_filter(F.col("doc_id")))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    # features in the scan of the texts, of which a hash alone goes on
    texts = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("int").alias("label"), F.xxhash64("text").alias("hash"), "text")
    scored = score_features(texts, ("doc_id", "label", "hash"), "text")
    rows = scored.orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(max_labelled).collect()
    if not rows:
        return PairwiseRanker()
    return PairwiseRanker().fit(np.array([r.features for r in rows]), np.array([r.label == 1 for r in rows]))


def score_quality(docs: DataFrame, ranker: PairwiseRanker, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``: 0 to 1, higher for better documents; null and empty texts get a score too.

    Rows pass through one by one: repeated rows, null keys, very long texts and empty tables need no care. A column of
    that name, in any case, is replaced.
    """
    at = docs.columns.index(text)
    names = docs.columns
    kept = [i for i, n in enumerate(names) if n.lower() != "quality_score"]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, f"c{at}"):
            scores = ranker.score(np.stack([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields), "score double"])
    return plain.mapInArrow(run, schema).toDF(*[names[i] for i in kept], "quality_score")


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n: the fold of a document (a null id has fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the fold 0 of 5 is held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = fit_ranker(docs, labels, lambda c: remainder(c, 5) != 0)
    scored = score_quality(pick(docs, doc_id="doc_id", text="text"), ranker)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the documents that score under the threshold.

    Each row is judged by its text alone: null ids, repeated rows, null, empty and very long texts pass or go by their
    score. Without labels all rows stay; an empty table stays empty; other columns, whatever their names, keep their values.
    """
    ranker = fit_ranker(docs, table(spark, sf_dir, "labels"), lambda c: F.lit(True))
    return masked(lambda d: score_quality(d, ranker).filter(F.col("quality_score") >= THRESHOLD), docs, ("text",))
