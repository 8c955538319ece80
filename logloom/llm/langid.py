"""Language identification by a bidirectional gated recurrent network over bytes.

The network runs over the UTF-8 bytes of a whole document, forwards and backwards, and labels every position with
log-probabilities of the languages; a document's probabilities are pooled over all its positions. Documents are read in
windows side by side. The state is carried into a window by running over the bytes next to it first, those before it
forwards and those after it backwards, so a position's label hangs on the words around it wherever the windows are cut.
Training is backpropagation through time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, table, text_chunks
from .quality import remainder

#: Documents that training uses at most over all languages, and bytes of their texts: the size of the sample that reaches
#: the driver.
MAX_DOCUMENTS, MAX_BYTES = 3_000, 1_200_000
#: Bytes of a window, and bytes on either side over which its state is carried.
STRIDE, CARRY = 512, 64
#: Bytes of a training sequence.
SEQUENCE = 128
#: Windows that are read side by side.
ROWS = 2048
HIDDEN = 8
LETTER = regex.compile(r"\p{L}")


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGRU:
    """Two gated recurrent layers side by side (forwards, backwards) and a softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        small = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {}
        for side in "fb":
            # input rows by byte for update gate, reset gate and candidate; the recurrent weights likewise
            self.p |= {f"x{side}": small(256, 3 * hidden), f"h{side}": small(hidden, 3 * hidden), f"c{side}": np.zeros(3 * hidden, np.float32)}
        self.p |= {"out": small(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}

    @staticmethod
    def matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes by position and row, zero-padded, and the lengths."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(lengths.max(initial=1))
        flat = np.zeros((len(parts), width), np.uint8)
        flat[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
        return np.ascontiguousarray(flat.T), lengths

    def layer(self, side: str, data: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states of one layer at every position; padding leaves the state as it is."""
        n, rows = data.shape
        h = np.zeros((rows, self.hidden), np.float32)
        states, cache, H = np.empty((n, rows, self.hidden), np.float32), {}, self.hidden
        wx, wh, c = self.p[f"x{side}"], self.p[f"h{side}"], self.p[f"c{side}"]
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            x = wx[data[t]] + c
            gates = sigmoid(x[:, : 2 * H] + h @ wh[:, : 2 * H])
            z, r = gates[:, :H], gates[:, H:]
            rh = r * h
            g = np.tanh(x[:, 2 * H :] + rh @ wh[:, 2 * H :])
            m = mask[t][:, None]
            new = h + m * (1 - z) * (g - h)
            if keep:
                cache[t] = (h, z, r, g)
            states[t] = h = new
        return states, cache

    def run_rows(self, side: str, data: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Hidden states of one layer over rows in descending order of length, of which ``active[t]`` go on to ``t``.

        ``data`` is in the order of reading: reversed for the backward layer.
        """
        H = self.hidden
        wx, wh = self.p[f"x{side}"] + self.p[f"c{side}"], self.p[f"h{side}"]
        # sigmoids from exponentials, of which processors without wide registers make more than of tanh; a tanh is twice a
        # sigmoid of twice the argument, less one
        wx, wh = np.concatenate([-wx[:, : 2 * H], -2 * wx[:, 2 * H :]], 1), np.concatenate([-wh[:, : 2 * H], -2 * wh[:, 2 * H :]], 1)
        w_gates, w_new = np.ascontiguousarray(wh[:, : 2 * H]), np.ascontiguousarray(wh[:, 2 * H :])
        x_gates, x_new = np.ascontiguousarray(wx[:, : 2 * H]), np.ascontiguousarray(wx[:, 2 * H :])
        states = np.zeros((*data.shape, H), np.float32)
        h = np.zeros((data.shape[1], H), np.float32)
        for t, k in enumerate(active.tolist()):
            h = h[:k]
            at = data[t, :k]
            gates = h @ w_gates
            gates += x_gates.take(at, 0)
            np.minimum(gates, 80, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            g = (gates[:, H:] * h) @ w_new
            g += x_new.take(at, 0)
            np.minimum(g, 80, out=g)
            np.exp(g, out=g)
            g += 1
            np.divide(2, g, out=g)
            g -= 1
            h = h - g
            h *= gates[:, :H]
            h += g
            states[t, :k] = h
        return states

    def window_scores(self, windows: list[bytes], skips: np.ndarray, takes: np.ndarray) -> np.ndarray:
        """For each window the sum of the log-probabilities of its ``takes`` positions after the first ``skips``.

        Windows come in descending order of length.
        """
        lengths = np.fromiter(map(len, windows), np.int64, len(windows))
        width = int(lengths.max(initial=0))
        flat = np.frombuffer(b"".join(windows), np.uint8)
        place = np.arange(width)[:, None]
        inside = place < lengths
        begin = np.cumsum(lengths) - lengths
        data = flat[np.minimum(begin + place, len(flat) - 1)]
        back = flat[np.clip(begin + lengths - 1 - place, 0, len(flat) - 1)]
        active = inside.sum(1)
        H, out, bias = self.hidden, self.p["out"], self.p["bias"]
        shape = (len(self.languages), *data.shape)
        # languages first, so that sums over them run along whole arrays
        logits = np.ascontiguousarray((self.run_rows("f", data, active).reshape(-1, H) @ out[:H]).T).reshape(shape)
        backward = np.ascontiguousarray((self.run_rows("b", back, active).reshape(-1, H) @ out[H:]).T).reshape(shape)
        turned, row = np.clip(lengths - 1 - place, 0, None), np.arange(len(windows))
        for k in range(len(logits)):
            logits[k] += backward[k][turned, row]
            logits[k] += bias[k]
        logits -= logits.max(0)
        logits -= np.log(np.exp(logits).sum(0))
        logits *= (place >= skips) & (place < skips + takes)
        return logits.sum(1, dtype=np.float64).T

    def scores(self, texts: list[bytes], stride: int = STRIDE, carry: int = CARRY) -> np.ndarray:
        """For each text the sum of its positions' log-probabilities, and their number in the last column."""
        parts = []
        for i, text in enumerate(texts):
            for at in range(0, len(text), stride):
                low, high = max(0, at - carry), min(len(text), at + stride + carry)
                parts.append((high - low, i, low, high, at - low, min(stride, len(text) - at)))
        parts.sort(key=lambda p: -p[0])  # rows of a batch have like lengths
        out = np.zeros((len(texts), len(self.languages) + 1))
        for k in range(0, len(parts), ROWS):
            some = parts[k : k + ROWS]
            _, which, low, high, skips, takes = (np.array(c) for c in zip(*some, strict=True))
            found = self.window_scores([texts[i][a:b] for i, a, b in zip(which.tolist(), low.tolist(), high.tolist(), strict=True)], skips, takes)
            np.add.at(out, (which, slice(0, -1)), found)
            np.add.at(out[:, -1], which, takes)
        return out

    def loss_and_gradients(self, data: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
        p, H = self.p, self.hidden
        mask = (np.arange(len(data))[:, None] < lengths).astype(np.float32)
        runs = {side: self.layer(side, data, mask, True) for side in "fb"}
        hidden = np.concatenate([runs[side][0] for side in "fb"], 2)
        logits = hidden @ p["out"] + p["bias"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        share = mask * weight
        share = share / share.sum()
        rows = np.arange(data.shape[1])
        loss = -(np.log(prob[:, rows, target] + 1e-12) * share).sum()
        d = prob
        d[:, rows, target] -= 1
        d *= share[:, :, None]
        grads = {"out": np.einsum("trh,trl->hl", hidden, d), "bias": d.sum((0, 1))}
        back = d @ p["out"].T
        for k, side in enumerate("fb"):
            cache, wh = runs[side][1], p[f"h{side}"]
            steps, gh, carried = np.zeros((*data.shape, 3 * H), wh.dtype), np.zeros_like(wh), np.zeros((data.shape[1], H), np.float32)
            for t in range(len(data) - 1, -1, -1) if side == "f" else range(len(data)):
                h, z, r, g = cache[t]
                m = mask[t][:, None]
                dh = carried + back[t, :, k * H : (k + 1) * H]
                dg = dh * m * (1 - z) * (1 - g * g)
                dz = dh * m * (h - g) * z * (1 - z)
                drh = dg @ wh[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                gates = np.concatenate([dz, dr], 1)
                gh[:, : 2 * H] += h.T @ gates
                gh[:, 2 * H :] += (r * h).T @ dg
                steps[t] = np.concatenate([gates, dg], 1)
                carried = dh * (1 - m * (1 - z)) + drh * r + gates @ wh[:, : 2 * H].T
            gx = np.stack([np.bincount(data.ravel(), column, 256) for column in steps.reshape(-1, 3 * H).T], 1).astype(wh.dtype)
            grads |= {f"x{side}": gx, f"h{side}": gh, f"c{side}": gx.sum(0)}
        return loss, grads

    def fit(self, texts: list[bytes], target: np.ndarray, epochs: int = 3, batch: int = 128, rate: float = 0.015, seed: int = 5) -> ByteGRU:
        """Adam over batches of sequences, into which whole texts are cut; languages weigh the same whatever their size."""
        parts = [(s[i : i + SEQUENCE], y) for s, y in zip(texts, target.tolist(), strict=True) for i in range(0, len(s), SEQUENCE)]
        counts = np.bincount([y for _, y in parts], minlength=len(self.languages))
        weight = (len(parts) / len(self.languages) / np.maximum(counts, 1)).astype(np.float32)
        draw, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        # small samples are gone over more often
        epochs = max(epochs, min(40, 200 * batch // max(1, len(parts))))
        total = max(1, epochs * -(-len(parts) // batch))
        for _ in range(epochs):
            order = draw.permutation(len(parts))
            for at in range(0, len(order), batch):
                some = [parts[j] for j in order[at : at + batch]]
                data, lengths = self.matrix([s for s, _ in some])
                y = np.array([y for _, y in some])
                _, grads = self.loss_and_gradients(data, lengths, y, weight[y])
                step += 1
                pace = rate * (1 - 0.9 * step / total)
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def fit_languages(docs: DataFrame, fold_filter, max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> ByteGRU | None:
    """Learn from ``text`` and non-null ``lang`` of the rows for which ``fold_filter(doc_id column)`` holds.

    The sample that reaches the driver has at most ``max_documents`` documents and ``max_bytes`` of text, as much of
    each language, in the order of a hash of the id. Of a text over a quarter of its language's bytes, a part of that
    size is used, whose place hangs on the hash; so every language is learned, however long its texts are. None if no row
    can be learned from.
    """
    own = pick(docs, doc_id="doc_id", text="text", lang="lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & fold_filter(F.col("doc_id")))
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_documents).collect()
    if not counts:
        return None
    quota, room = max(1, max_documents // len(counts)), max_bytes // len(counts)
    rates = docs.sparkSession.createDataFrame([(r[0], min(1.0, (2.0 * quota + 20) / r[1])) for r in counts], "lang string, rate double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit("lang sample")), F.lit(1 << 20)) / F.lit(1 << 20)
    # characters that a quarter of the language's room holds
    most = F.greatest(F.floor(F.lit(max(room // 4, 1)).cast("long") * F.length("text") / F.greatest(F.octet_length("text"), F.lit(1))), F.lit(1)).cast("int")
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - most + 1, F.lit(1))).cast("int") + 1
    part = F.when(F.octet_length("text") > max(room // 4, 1), F.substring("text", place, most)).otherwise(F.col("text"))
    drawn = own.join(F.broadcast(rates), "lang").filter(unit < F.col("rate")).withColumn("text", part)
    size = F.octet_length("text")
    rank = F.struct(F.xxhash64("doc_id", F.lit("lang sample")).alias("h"), "doc_id", F.xxhash64("text").alias("t")).alias("rank")
    first = Window.partitionBy("lang").orderBy("rank")
    # numbers are ranked before any text is shuffled
    ranked = drawn.select("lang", rank, size.alias("size")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= quota)
    upto = ranked.withColumn("upto", F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("upto") <= room) | (F.col("n") == 1))
    chosen = upto.select("lang", "rank").distinct()
    rows = drawn.select("lang", rank, "text").join(F.broadcast(chosen), ["lang", "rank"], "left_semi").dropDuplicates(["lang", "rank"]).collect()
    rows.sort(key=lambda r: (r.lang, r["rank"].h, str(r["rank"].doc_id), r["rank"].t))
    languages = sorted({r.lang for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    pairs = [(text_bytes(r.text), number[r.lang]) for r in rows]
    model = ByteGRU(languages)
    return model.fit([w for w, _ in pairs], np.array([y for _, y in pairs], np.int64)) if any(w for w, _ in pairs) else (model if languages else None)


def predict_languages(docs: DataFrame, model: ByteGRU | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of each whole text.

    Null texts and texts without a letter, and all texts if nothing was learned, are ``und`` with score 0. Log-
    probabilities are averaged over the positions and sharpened by the square root of their number. Rows pass one by
    one: repeated rows, null keys, very long texts and empty tables need no care; other columns are left out.
    """
    rows = pick(docs, key=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, chunk=2 << 20):
            found = [text_bytes(t) if model and t and LETTER.search(t) else b"" for t in texts]
            totals = model.scores(found) if model else np.zeros((len(texts), 1))
            lang, score = [], []
            for total in totals:
                if not total[-1]:
                    lang.append("und")
                    score.append(0.0)
                    continue
                pooled = total[:-1] / np.sqrt(total[-1])
                p = np.exp(pooled - pooled.max())
                best = int(p.argmax())
                lang.append(model.languages[best])
                score.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the fold 2 of 4 is held out of the training."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, lambda c: remainder(c, 4) != 2)
    out = predict_languages(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
