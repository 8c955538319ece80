"""Byte-pair encoding and decoding by a pair occurrence index.

A task cuts its texts into pieces, keeps the distinct ones, and lays their byte tokens out in one flat array with
links to both neighbours. An index maps the rank of every adjacent pair to all its positions. Ranks are then taken
in ascending order from a heap; all positions of a rank are merged at once, and the pairs that arise to the left and
right are entered under their own ranks, which are always higher. That gives each piece the merges that the greedy
encoder would have made, for all pieces together.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, text_chunks

#: Characters of text whose pieces share one index: the bound of a task's memory. A rank costs the same for few or many
#: positions, so this is large.
INDEX_CHARS = 8 << 20


class Numbers(dict):
    """Numbers pieces as they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The slices ``flat[starts[i] : starts[i] + lengths[i]]`` for each i of ``which``, one after the other."""
    n = lengths[which]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def default_vocabulary() -> str:
    """The 50k byte-level vocabulary of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in vocabulary files of this kind: itself where printable, else 256, 257, ..."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return [others.get(b, chr(b)) for b in range(256)]


class PairIndexCodec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        back = {s: b for b, s in enumerate(byte_symbols())}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.array([vocab[s] for s in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        # white space is Unicode's own here, without the separators 0x1c to 0x1f
        space = (pattern or public_tokenizers.PATTERN).replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.cut = regex.compile(space).findall
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        self.token_length = np.fromiter(map(len, self.token_bytes), np.int64, size)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.by_key[at], -1)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all pieces in one array; the start and the number of each piece's ids."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(lengths.sum())
        starts = np.cumsum(lengths) - lengths
        token = np.full(n + 1, -1, np.int64)
        token[:n] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        following = np.arange(1, n + 2)
        following[(starts + lengths)[lengths > 0] - 1] = n
        preceding = np.arange(-1, n)
        preceding[starts[lengths > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            ranks = self._ranks(token[at], token[following[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(part)

        first = np.arange(n)
        enter(first[following[:n] < n])
        while active:
            rank = heapq.heappop(active)
            parts = index.pop(rank)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            left, right = self.left[rank], self.right[rank]
            after = following[at]
            good = (token[at] == left) & (after < n) & (token[after] == right)
            at, after = at[good], after[good]
            if not len(at):
                continue
            if left == right:  # of overlapping positions in a run, every other one, from the left
                at = np.unique(at)
                run = np.concatenate(([True], following[at[:-1]] != at[1:]))
                begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
                after = following[at]
            token[at] = self.made[rank]
            token[after] = -1
            beyond = following[after]
            following[at] = beyond
            inner = beyond < n
            preceding[beyond[inner]] = at[inner]
            before = preceding[at]
            enter(np.concatenate((before[before >= 0], at[inner])))
        kept = token[:n] >= 0
        ids = token[:n][kept].astype(np.int32)
        count = np.concatenate(([0], np.cumsum(kept)))
        return ids, count[starts], count[starts + lengths] - count[starts]

    def _pieces(self, text: str, specials: bool) -> list[str]:
        if specials and self.special_cut and any(s in text for s in self.specials):
            return [p for part in self.special_cut(text) for p in ([part] if part in self.specials else self.cut(part))]
        return self.cut(text)

    def encode(self, texts: list[str | None], specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts (null: none) in one array, and where each text's ids end.

        The strings of special tokens give their ids, or without ``specials`` those of their characters.
        """
        number = Numbers()
        cut = [np.fromiter(map(number.__getitem__, p), np.int32, len(p)) for p in (self._pieces(t or "", specials) for t in texts)]
        flat, starts, lengths = self.merge_all([b"" if specials and p in self.specials else p.encode() for p in number])
        for piece, i in self.specials.items():
            if specials and piece in number:
                starts[number[piece]], lengths[number[piece]], flat = len(flat), 1, np.append(flat, np.int32(i))
        which = np.concatenate(cut) if cut else np.zeros(0, np.int32)
        sizes = np.concatenate(([0], np.cumsum(lengths[which])))
        return ragged(flat, starts, lengths, which), sizes[np.cumsum([len(x) for x in cut], dtype=np.int64)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become the replacement character."""
        return ragged(self.all_bytes, self.token_start, self.token_length, ids).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PairIndexCodec:
    return PairIndexCodec(path)


def bpe_round_trip(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """Keys with ``token_ids`` (array of int) of each whole text and ``decoded``, the text that the ids give back.

    Null and empty texts have no ids and decode to an empty string. Rows are neither joined nor dropped, so repeated
    keys, null keys and empty tables pass through; other columns are left out. There is no shuffle.
    """
    path = vocabulary or default_vocabulary()
    rows = pick(df, **{f"key{i}": k for i, k in enumerate(keys)}, text=text)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, texts in text_chunks(batches, chunk=INDEX_CHARS):
            ids, ends = own.encode(texts)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            decoded = [own.decode(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            arrays += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "token_ids", "decoded"])

    schema = ", ".join([*(f"key{i} {kinds[f'key{i}']}" for i in range(len(keys))), "token_ids array<int>", "decoded string"])
    return rows.mapInArrow(run, schema).toDF(*keys, "token_ids", "decoded")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    coded = bpe_round_trip(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents with ``token_ids``, ``n_tokens`` and ``decoded``; columns of these names, in
    any case, are replaced.

    Rows pass one by one, so repeated ones, null ids and very long texts need no care; null and empty texts have no
    ids; an empty table stays empty.
    """
    del spark, sf_dir
    coded = bpe_round_trip(docs, keys=tuple(c for c in docs.columns if c.lower() not in ("token_ids", "decoded", "n_tokens")))
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))
