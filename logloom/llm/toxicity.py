"""Toxicity by a convolutional text classifier.

Words and their first and last letters are hashed into one table of embeddings. Filters over one, two and three words
run over the whole text, each keeps its greatest value, and a linear layer over these gives the score. All of it is
trained in numpy by backpropagation. The threshold is calibrated for each language on labelled texts that the training
did not see. A text's language is guessed from its hashed words, never read from a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, text_chunks
from .quality import remainder

#: Labelled documents of each class that the fit uses at most (those with the least hash of their id), and bytes of
#: their texts. Of a text over ``MAX_TEXT`` characters, a part of that length is used, whose place hangs on its hash.
MAX_LABELLED, MAX_BYTES, MAX_TEXT = 2_000, 8_000_000, 500_000
#: The score at and above which a document is toxic: that of its language's threshold.
THRESHOLD = 0.7
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 12, 12, (1, 2, 3)
#: Buckets of the language tables.
LANGUAGE_BUCKETS = 1 << 15
#: Words of a batch, in training and in scoring.
BATCH_WORDS = 120_000
#: Texts of the sample that must hold a bucket before it is learned.
MIN_TEXTS = 2
#: Every fourth labelled document is kept for the thresholds.
CALIBRATION = 4
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def buckets_of(word: str) -> list[int]:
    """The word under two hashes, and its ends, with which unseen forms of a word are met."""
    parts = ("w" + word, "v" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "e" + word[-4:])
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


PARTS = len(buckets_of("word"))


class Vocabulary:
    """Numbers of words as they are met, and what is known of each; cleared when it has grown to its bound."""

    def __init__(self, rows_of, width: int, dtype, limit: int = 300_000):
        self.rows_of, self.limit = rows_of, limit
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, width), dtype)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers that hold until the next call."""
        if len(self.number) > self.limit:
            self.number = {}
        known = len(self.number)
        number = self.number
        out = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if len(number) > known:
            if len(number) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((len(number), self.rows.shape[1]), self.rows.dtype)))
            fresh = list(number)[known:] if known == 0 else [w for w in dict.fromkeys(words) if number[w] >= known]
            self.rows[known : len(number)] = self.rows_of(fresh)
        return out


class TextCNN:
    def __init__(self, languages: list[str], seed: int = 13):
        draw = np.random.default_rng(seed)
        self.p = {"embed": (draw.standard_normal((BUCKETS, DIMS)) * 0.02).astype(np.float32)}
        for h in WIDTHS:
            self.p |= {f"w{h}": (draw.standard_normal((h, DIMS, FILTERS)) * 0.5).astype(np.float32), f"b{h}": np.zeros(FILTERS, np.float32)}
        self.p |= {"out": (draw.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), "bias": np.full(1, -1.0, np.float32)}
        self.languages = languages
        self.language_logs = np.zeros((LANGUAGE_BUCKETS, len(languages)), np.float32)
        self.cuts = np.zeros(len(languages))  # threshold of each language, as a logit
        self.cut = 0.0

    def convolve(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest value of each filter in each text, and the places' values. Texts lie one after the other in ``x``, each
        followed by as many rows of zeros as the widest filter needs."""
        pooled, values = [], []
        for h in WIDTHS:
            w = self.p[f"w{h}"]
            v = x @ w[0]
            for j in range(1, h):
                v[: len(x) - j] += x[j:] @ w[j]
            v += self.p[f"b{h}"]
            for j in range(1, h):  # a window that would reach into the next text
                v[starts + sizes - j] = -np.inf
            values.append(v)
            pooled.append(np.maximum.reduceat(v, starts, axis=0) if len(starts) else np.zeros((0, FILTERS), np.float32))
        return np.concatenate(pooled, 1), values

    @staticmethod
    def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First row and number of rows of each text, and the rows of its words; a text without words has rows of zeros."""
        sizes = counts + max(WIDTHS) - 1
        starts = np.cumsum(sizes) - sizes
        rows = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return starts, sizes, rows

    def logits(self, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of texts whose word vectors follow each other."""
        starts, sizes, rows = self.layout(counts)
        x = np.zeros((int(sizes.sum()), DIMS), np.float32)
        x[rows] = vectors
        pooled, _ = self.convolve(x, starts, sizes)
        return np.maximum(pooled, 0) @ self.p["out"] + self.p["bias"][0]

    def gradients(self, own: np.ndarray, buckets: np.ndarray, keep: np.ndarray, counts: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Weighted cross-entropy and its gradients, those of the embeddings as rows and their values. ``own`` has the number
        of each word, ``buckets`` and ``keep`` (how much each bucket counts) have a row for each number."""
        p = self.p
        starts, sizes, rows = self.layout(counts)
        x = np.zeros((int(sizes.sum()), DIMS), p["embed"].dtype)
        x[rows] = np.einsum("npd,np->nd", p["embed"][buckets], keep)[own]
        pooled, values = self.convolve(x, starts, sizes)
        hidden = np.maximum(pooled, 0)
        logit = hidden @ p["out"] + p["bias"][0]
        chance = 1 / (1 + np.exp(-logit))
        share = weight / weight.sum()
        loss = -(share * np.where(target, np.log(chance + 1e-12), np.log(1 - chance + 1e-12))).sum()
        d = share * (chance - target)
        grads = {"out": hidden.T @ d, "bias": d.sum(keepdims=True)}
        back = (d[:, None] * p["out"]) * (pooled > 0)
        place = np.arange(len(x))[:, None]
        at, parts = [], []
        for k, h in enumerate(WIDTHS):
            best = pooled[:, k * FILTERS : (k + 1) * FILTERS]
            first = np.minimum.reduceat(np.where(values[k] == np.repeat(best, sizes, axis=0), place, len(x)), starts, axis=0)
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"b{h}"] = g.sum(0)
            grads[f"w{h}"] = np.empty_like(p[f"w{h}"])
            for j in range(h):
                inside = np.minimum(first + j, len(x) - 1)
                good = g * (first + j < len(x))
                grads[f"w{h}"][j] = np.einsum("tfd,tf->df", x[inside], good)
                at.append(inside.ravel())
                parts.append((good[:, :, None] * p[f"w{h}"][j].T).reshape(-1, DIMS))
        # only words at the places of greatest values have a gradient
        word = np.full(len(x), -1)
        word[rows] = own
        at, parts = word[np.concatenate(at)], np.concatenate(parts)
        at, parts = at[(at >= 0)], parts[(at >= 0)]
        touched, inverse = np.unique(buckets[at].ravel(), return_inverse=True)
        shares = (parts[:, None, :] * keep[at][:, :, None]).reshape(-1, DIMS)
        rows_grad = np.stack([np.bincount(inverse, c, len(touched)) for c in shares.T], 1).astype(x.dtype) if len(touched) else np.zeros((0, DIMS), x.dtype)
        return loss, grads, touched, rows_grad

    def fit(self, texts: list[list[str]], target: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.02, seed: int = 17) -> TextCNN:
        """Adam over batches of whole texts; words are left out of their own buckets at random, so that their ends count too."""
        words = Vocabulary(lambda fresh: np.array([buckets_of(w) for w in fresh]), PARTS, np.int64, 1 << 40)
        numbers = [words.numbers(t) for t in texts]
        counts = np.fromiter(map(len, numbers), np.int64, len(numbers))
        # buckets of a single text tell nothing of others
        holds = np.zeros(BUCKETS, np.int32)
        for own in numbers:
            holds[np.unique(words.rows[own])] += 1
        self.p["embed"][holds < MIN_TEXTS] = 0
        draw, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        epochs = max(epochs, min(30, 6_000 // max(1, len(texts))))  # small samples are gone over more often
        for epoch in range(epochs):
            order, at, losses = draw.permutation(len(texts)), 0, []
            pace = rate * (1 - 0.9 * epoch / epochs)
            while at < len(order):
                upto = at + 1
                while upto < len(order) and upto - at < 32 and counts[order[at:upto]].sum() < BATCH_WORDS // 4:
                    upto += 1
                some, at = order[at:upto], upto
                distinct, own = np.unique(np.concatenate([numbers[i] for i in some]), return_inverse=True)
                buckets = words.rows[distinct]
                keep = (holds[buckets] >= MIN_TEXTS) * np.float32(1 / PARTS)
                keep[:, :2] *= draw.random((len(distinct), 1)) > 0.3
                loss, grads, touched, rows_grad = self.gradients(own, buckets, keep, counts[some], target[some], weight[some])
                losses.append(loss)
                step += 1
                moved = [(k, slice(None), g) for k, g in grads.items()] + [("embed", touched, rows_grad)]
                for k, which, g in moved:
                    a = first[k][which] = 0.9 * first[k][which] + 0.1 * g
                    b = second[k][which] = 0.99 * second[k][which] + 0.01 * g * g
                    self.p[k][which] -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
            if np.mean(losses) < 0.01:
                break
        self.p["embed"][holds < MIN_TEXTS] = 0
        return self

    def fit_languages(self, texts: list[list[str]], language: np.ndarray) -> None:
        counts = np.ones((LANGUAGE_BUCKETS, len(self.languages)))
        for words, y in zip(texts, language.tolist(), strict=True):
            if y >= 0 and words:
                np.add.at(counts, (self.language_rows(words), y), 1 / len(words))
        self.language_logs = np.log(counts / counts.sum(0)).astype(np.float32)

    @staticmethod
    def language_rows(words: list[str]) -> np.ndarray:
        return np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "replace")) % LANGUAGE_BUCKETS for w in words])

    def vocabulary(self) -> Vocabulary:
        """What scoring needs of each word: its vector and its logarithms by language."""

        def rows_of(fresh: list[str]) -> np.ndarray:
            vectors = self.p["embed"][np.array([buckets_of(w) for w in fresh])].mean(1)
            return np.concatenate((vectors, self.language_logs[self.language_rows(fresh)]), 1)

        return Vocabulary(rows_of, DIMS + len(self.languages), np.float32)

    def read(self, texts: list[list[str]], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Logit and number of the guessed language (-1: none) of each text, whole, some texts at a time."""
        logits, language, at = [], [], 0
        while at < len(texts):
            upto, n = at + 1, len(texts[at])
            while upto < len(texts) and n + len(texts[upto]) <= BATCH_WORDS:
                n += len(texts[upto])
                upto += 1
            counts = np.array([len(t) for t in texts[at:upto]])
            known = words.numbers([w for t in texts[at:upto] for w in t])
            rows = words.rows[known]
            logits.append(self.logits(rows[:, :DIMS], counts))
            sums = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(rows[:, DIMS:], 0, dtype=np.float64)))
            ends = np.cumsum(counts)
            language.append(np.where(counts > 0, (sums[ends] - sums[ends - counts]).argmax(1), -1) if self.languages else np.full(len(counts), -1))
            at = upto
        return (np.concatenate(logits), np.concatenate(language)) if logits else (np.zeros(0), np.zeros(0, np.int64))

    def scores(self, texts: list[list[str]], words: Vocabulary) -> np.ndarray:
        logits, language = self.read(texts, words)
        cuts = np.append(self.cuts, self.cut)[language]  # the last is for no language
        return 1 / (1 + np.exp(-np.clip(logits - cuts, -30, 30)) * (1 - THRESHOLD) / THRESHOLD)

    def calibrate(self, texts: list[list[str]], target: np.ndarray, weight: np.ndarray) -> None:
        """The cut of least weighted error, for all and for each language; of equal ones, the middle. A language's own labels
        count with those of all at a weight that stands for ten texts."""
        if not len(texts):
            return
        logits, language = self.read(texts, self.vocabulary())
        self.cut = best_cut(logits, target, weight)
        for k in range(len(self.languages)):
            own = language == k
            prior = 10 / len(texts)
            self.cuts[k] = best_cut(logits, target, weight * np.where(own, 1.0, prior)) if own.any() else self.cut


def best_cut(logits: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(logits, kind="stable")
    z, y, w = logits[order], target[order], weight[order]
    # error if the first k texts count as clean
    error = np.append(0, np.cumsum(np.where(y, w, -w))) + w[~y].sum()
    valid = np.append(True, np.append(z[1:] != z[:-1], True))
    error = np.where(valid, error, np.inf)
    best = np.flatnonzero(error <= error.min() + 1e-9)
    k = int(best[len(best) // 2])
    if k == 0:
        return float(z[0]) - 1e-6
    if k == len(z):
        return float(z[-1]) + 1.0
    return float((z[k - 1] + z[k]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold_filter, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> TextCNN | None:
    """Fit on the labelled rows (doc_id, toxic) for which ``fold_filter(doc_id column)`` holds; ``lang`` of ``docs`` only tells
    which texts a language's words and threshold are learned from.

    Rows with a null id or label, or a label other than 0 and 1, do not count. At most ``max_labelled`` of each label, in
    the order of their id's hash, and ``max_bytes`` of their texts reach the driver. None without both labels.
    """
    usable = pick(labels, doc_id="doc_id", toxic="toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & fold_filter(F.col("doc_id")))
    totals = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    one = lambda y: usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = one(0).unionByName(one(1))
    own = pick(docs, doc_id="doc_id", text="text", lang="lang").filter(F.col("text").isNotNull())
    size, most = F.length("text"), min(MAX_TEXT, max(1, max_bytes // 8))
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(size - most + 1, F.lit(1))) + 1
    part = F.when(size > most, F.substring("text", place, F.lit(most))).otherwise(F.col("text"))
    # both labels get the same room, and within it texts come by the order of their hash
    met = own.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "lang", F.xxhash64("text").alias("hash"), F.octet_length(part).alias("size"), part.alias("text"))
    places = sorted((r.toxic, r.hash, r.size) for r in met.select("toxic", F.xxhash64("doc_id", "hash").alias("hash"), "size").orderBy("hash").limit(2 * max_labelled).collect())
    last, held = {}, {0: 0, 1: 0}
    for toxic, h, n in places:
        if held[toxic] <= max_bytes // 2:
            held[toxic] += n
            last[toxic] = h
    within = F.xxhash64("doc_id", "hash") <= F.when(F.col("toxic") == 1, F.lit(last.get(1, -(1 << 63)))).otherwise(F.lit(last.get(0, -(1 << 63))))
    rows = met.filter(within).orderBy(F.xxhash64("doc_id", "hash"), "doc_id").limit(2 * max_labelled).collect()
    target = np.array([r.toxic == 1 for r in rows])
    if not target.any() or target.all():
        return None
    texts = [words_of(r.text) for r in rows]
    languages = sorted({r.lang for r in rows if r.lang is not None})
    spoken = np.array([languages.index(r.lang) if r.lang is not None else -1 for r in rows])
    # samples weigh as much as their labels do in the table
    weight = np.where(target, totals[1] / target.sum(), totals[0] / (~target).sum())
    weight /= weight.mean()
    model = TextCNN(languages)
    held_back = np.arange(len(rows)) % CALIBRATION == 0
    if not (0 < target[held_back].sum() < held_back.sum()) or not (0 < target[~held_back].sum() < (~held_back).sum()):
        held_back = np.zeros(len(rows), bool)  # too few to hold any back: the thresholds are set on the texts learned from
    learn = np.flatnonzero(~held_back)
    tune = np.flatnonzero(held_back) if held_back.any() else learn
    model.fit([texts[i] for i in learn], target[learn], np.sqrt(weight[learn]))
    model.fit_languages(texts, spoken)
    model.calibrate([texts[i] for i in tune], target[tune], weight[tune])
    return model


def predict_toxicity(docs: DataFrame, model: TextCNN | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` (0 to 1, ``THRESHOLD`` at the cut of the text's language) of every whole text.

    Null and empty texts, and texts without words, score as texts in which no filter finds anything. Without labels to
    learn from every score is 0. Rows pass one by one: repeated rows, null keys, very long texts, ties and empty tables
    need no care; other columns, whatever their names, are left out.
    """
    rows = pick(docs, key=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.vocabulary() if model else None
        for batch, texts in text_chunks(batches, chunk=1 << 20):
            found = model.scores([words_of(t) for t in texts], words) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["key", "score"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the fold 1 of 3 is held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, lambda c: remainder(c, 3) != 1)
    out = predict_toxicity(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
