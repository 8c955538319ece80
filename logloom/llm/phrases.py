"""Phrase collocations by direct-address tiles.

1. The words of each language are counted, and those frequent enough get ids in order of their frequency.
2. A task turns some millions of characters of a language into ids and counts neighbouring pairs by tiles of 512 x 512
   ids: a tile that holds many pairs is counted in a dense table with ``bincount``, the pairs of all others by sorting
   their coordinates. The counts of all tasks are added up in one shuffle.
3. The frequent pairs are ranked anew and become the left ids of the next level, so pairs of (pair, word) count the
   phrases of three words, and pairs of (three words, word) those of four. A phrase is only counted where the two phrases
   of one word less that it holds are frequent.
4. Candidates are joined with the counts of their parts and with the longer candidates around them, scored, and cut down
   to the first of each language within tasks before these are ranked.

The symbols that every task knows are bounded by ``MAX_SYMBOLS`` a level, the most frequent ones. What is not among them
gets ids of its own within a task, behind the known ones, and is counted there as well: so the bound changes how much is
shuffled, and no count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, save, table, text_chunks

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2_000
#: A candidate goes if a longer one around it has this share of its occurrences, in hundredths.
COVERED = 80
#: Symbols of a level, over all languages, that are known to every task.
MAX_SYMBOLS = 400_000
#: Bits of an id within its tile, and the pairs that make a tile dense.
TILE_BITS, DENSE = 9, 1 << 14
#: Characters of a language that a task counts at a time.
CHUNK = 12 << 20
#: Parts that the rows of a frequent single word are dealt to when candidates look up their parts.
SALTS = 16

#: A-Z as a-z; what ends a piece as a byte that UTF-8 does not have.
BREAK = b"\xff"
PREPARE = bytes(b"\xff"[0] if chr(i) in ".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words, with ``BREAK`` between pieces."""
    return (text or "").encode("utf-8", "replace").translate(PREPARE).replace(BREAK, b" \xff ").split()


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ids and how often each occurs."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = int(right.max(initial=0) >> TILE_BITS) + 1
    tile = (left >> TILE_BITS) * width + (right >> TILE_BITS)
    order = np.argsort(tile, kind="stable")
    left, right, tile = left[order], right[order], tile[order]
    edges = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True]))) if len(tile) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    mask = (1 << TILE_BITS) - 1
    for a, n in zip(edges[:-1][sizes >= DENSE].tolist(), sizes[sizes >= DENSE].tolist(), strict=True):
        cells = np.bincount((left[a : a + n] & mask) << TILE_BITS | right[a : a + n] & mask, minlength=1 << 2 * TILE_BITS)
        held = np.flatnonzero(cells)
        out.append(((left[a] & ~mask) + (held >> TILE_BITS), (right[a] & ~mask) + (held & mask), cells[held]))
    sparse = np.repeat(sizes < DENSE, sizes)
    codes = np.sort(left[sparse] << 32 | right[sparse])
    if len(codes):
        new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        out.append((codes[new] >> 32, codes[new] & 0xFFFFFFFF, np.diff(np.append(new, len(codes)))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def join_parts(lefts: pa.Array, left: np.ndarray, rights: pa.Array, right: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(lefts.take(pa.array(left)), rights.take(pa.array(right)), pa.scalar(b" ", pa.binary()))


class Known:
    """The symbols of a language that every task knows: words by rank, and for phrases of two and three words the codes
    (left symbol and right word) by rank; and for each level whether these are all frequent ones. All are Arrow and numpy
    arrays, as the driver holds those of all languages."""

    def __init__(self, words: pa.Array, complete: bool):
        self.words, self.complete = words, [complete]
        self.codes: list[np.ndarray] = []

    def add(self, phrases: pa.Array, complete: bool) -> None:
        """Phrases of one word more, by rank. Those with a part that is not known stay unknown."""
        parts = pc.split_pattern(phrases, b" ", max_splits=1, reverse=True).flatten()
        first, last = (parts.take(pa.array(np.arange(i, len(parts), 2))) for i in range(2))
        left, right = pc.index_in(first, self.names()[-1]), pc.index_in(last, self.words)
        held = pc.and_(left.is_valid(), right.is_valid())
        left, right = (x.filter(held).to_numpy().astype(np.int64) for x in (left, right))
        self.complete.append(complete and len(left) == len(phrases))
        self.codes.append(left << 32 | right)

    def names(self) -> list[pa.Array]:
        """The symbols of each level as phrases."""
        found = [self.words]
        for codes in self.codes:
            found.append(join_parts(found[-1], codes >> 32, self.words, codes & 0xFFFFFFFF))
        return found


class Numbers(dict):
    """Ids of words; -1 for what cannot be frequent, ids behind the known ones for what may be."""

    def __init__(self, known: Known):
        super().__init__(zip(known.words.to_pylist(), range(len(known.words)), strict=True))
        self[BREAK] = -1
        self.complete, self.more = known.complete[0], []
        self.bound = len(known.words)

    def __missing__(self, word: bytes) -> int:
        if self.complete:
            return -1
        self[word] = at = self.bound + len(self.more)
        self.more.append(word)
        return at

    def forget(self) -> None:
        for w in self.more:
            del self[w]
        self.more = []


class LevelCounter:
    """Counts the phrases of m words of one language, some millions of characters at a time."""

    def __init__(self, known: Known, m: int):
        self.known, self.m, self.numbers = known, m, Numbers(known)
        self.order = [np.argsort(c) for c in known.codes]
        self.sorted = [c[o] for c, o in zip(known.codes, self.order, strict=True)]
        self.names = known.names()
        self.ids: list[np.ndarray] = []
        self.size = 0

    def read(self, text: str) -> None:
        tokens = tokens_of(text)
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.ids.append(np.full(1, -1))
        self.size += len(text)

    def counted(self) -> tuple[pa.Array, np.ndarray]:
        """Phrases and counts of what was read since the last call."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        names = [pa.concat_arrays([self.names[0], pa.array(self.numbers.more, pa.binary())]), *self.names[1:]]
        words = names[0]
        left, right = ids[:-1], ids[1:]
        place = np.flatnonzero((left >= 0) & (right >= 0))
        left, right = left[place], right[place]
        for level in range(self.m - 2):
            # symbols of the phrases at these places
            codes, known = left << 32 | right, self.sorted[level]
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            symbol = np.where(hit, self.order[level][at] if len(known) else 0, -1)
            if not self.known.complete[level + 1]:
                more, number = np.unique(codes[~hit], return_inverse=True)
                symbol[~hit] = len(known) + number
                names[level + 1] = pa.concat_arrays([names[level + 1], join_parts(names[level], more >> 32, words, more & 0xFFFFFFFF)])
            # both the phrase here and the one a word on must be symbols
            place, symbol = place[symbol >= 0], symbol[symbol >= 0]
            on = np.flatnonzero(place[1:] == place[:-1] + 1)
            place, left = place[on], symbol[on]
            right = ids[place + level + 2]
        left, right, counts = count_pairs(left, right)
        found = join_parts(names[self.m - 2], left, words, right)
        self.ids, self.size = [], 0
        self.numbers.forget()
        return found, counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words, from (lang, text), and under a null phrase the words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            lang, word, n = [], [], []
            for g, found in counts.items():
                found.pop(BREAK, None)
                lang += [g] * (len(found) + 1)
                word += [*found, None]
                n += [*found.values(), sum(found.values())]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

        for batch, found in text_chunks(batches):
            for g, t in zip(batch.column(0).to_pylist(), found, strict=True):
                counts.setdefault(g, Counter()).update(tokens_of(t))
                size += len(t)
            if size > CHUNK or sum(map(len, counts.values())) > 500_000:
                yield rows()
                size = 0
        yield rows()

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(texts: DataFrame, known: dict[str, Known], m: int, chunk: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of m words that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, LevelCounter] = {}

        def rows(g: str) -> Iterator[pa.RecordBatch]:
            phrases, counts = open_[g].counted()
            if len(counts):
                full = pa.RecordBatch.from_arrays([pa.array([g], pa.string()).take(pa.array(np.zeros(len(counts), np.int64))), phrases.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])
                for at in range(0, len(counts), 50_000):
                    yield full.slice(at, 50_000)

        for batch, found in text_chunks(batches):
            for g, t in zip(batch.column(0).to_pylist(), found, strict=True):
                if g not in known:  # a language without a frequent word
                    continue
                if g not in open_:
                    open_[g] = LevelCounter(known[g], m)
                open_[g].read(t)
                if sum(c.size for c in open_.values()) > chunk:  # the language with most text
                    yield from rows(max(open_, key=lambda x: open_[x].size))
        for g in open_:
            yield from rows(g)

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, limit: int) -> tuple[dict[str, pa.Array], bool]:
    """The phrases of each language in a written table with the greatest counts, at most ``limit`` of them over all
    languages, by rank, and whether these are all.

    Counts are cut at an eighth of a power of two, which a table of some hundred rows tells.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(counts.groupBy(step.alias("bin")).count().collect(), reverse=True)
    held, cut = 0, None
    for r in bins:
        if held + r["count"] > limit:
            break
        held, cut = held + r["count"], r["bin"]
    complete = cut is None if not bins else cut == bins[-1]["bin"]
    if cut is None:
        return {}, not bins
    rows = counts.filter(step >= cut).select("lang", F.col("phrase").cast("binary").alias("phrase"), "n").toArrow()
    rows = rows.sort_by([("n", "descending"), ("phrase", "ascending")])
    return {g: rows.filter(pc.equal(rows["lang"], g))["phrase"].combine_chunks() for g in pc.unique(rows["lang"]).to_pylist()}, complete


def count_levels(texts: DataFrame, min_count: int, max_words: int, max_symbols: int, chunk: int) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, n) of the frequent phrases of 1, 2 ... words, and (lang, n), the words of each language."""
    words = save(word_counts(texts).filter(F.col("phrase").isNull() | (F.col("n") >= min_count)), "words")
    totals = words.filter("phrase is null").select("lang", "n")
    levels = [words.filter("phrase is not null")]
    none = pa.array([], pa.binary())
    found, complete = most_frequent(levels[0], max_symbols)
    known = {g: Known(found.get(g, none), complete) for g in (found if complete else [r.lang for r in totals.collect()])}
    for m in range(2, max_words + 1):
        levels.append(save(phrase_counts(texts, known, m, chunk).filter(F.col("n") >= min_count), f"phrases{m}"))
        if m < max_words:
            found, complete = most_frequent(levels[-1], max_symbols)
            for g, k in known.items():
                k.add(found.get(g, none), complete)
    return levels, totals


def score_candidates(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate covers."""
    counts = [d.select("lang", "phrase", "n", F.lit(i + 1).alias("m")) for i, d in enumerate(levels)]
    candidates = counts[1]
    for d in counts[2:]:
        candidates = candidates.unionByName(d)
    words = F.split("phrase", " ")
    # phrases of two words and more inside longer ones
    longer = candidates.filter("m > 2").select("lang", "n", "m", words.alias("w"))
    inner = longer.select("lang", "n", "m", "w", F.explode(F.expr("sequence(2, m - 1)")).alias("size")).select("lang", "n", "w", "size", F.explode(F.expr("sequence(1, m - size + 1)")).alias("at"))
    around = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    left = candidates.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < COVERED * F.col("n"), F.lit(True))).drop("around")
    # the two parts of every cut; rows of frequent single words are dealt to several groups
    cuts = left.select("lang", "phrase", "n", "m", words.alias("w"), F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "n", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"), (F.col("m") - F.col("k")).alias("k2"))
    known = counts[0].select("lang", F.col("phrase").alias("part"), "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    for d in counts[1:-1]:
        known = known.unionByName(d.select("lang", F.col("phrase").alias("part"), "n", F.lit(0).alias("salt")))
    salt = lambda size: F.when(F.col(size) == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    cuts = cuts.withColumn("salt", salt("k")).join(known.select("lang", F.col("part").alias("first"), "salt", F.col("n").alias("l")), ["lang", "first", "salt"])
    cuts = cuts.withColumn("salt", salt("k2")).join(known.select("lang", F.col("part").alias("rest"), "salt", F.col("n").alias("r")), ["lang", "rest", "salt"])
    score = F.expr("cast(cast(n as decimal(20,0)) * 2000000 div (l + r) as bigint)")
    least = cuts.groupBy("lang", "phrase").agg(F.first("n").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def first_of_each(scored: DataFrame, top: int) -> DataFrame:
    """``scored``, a written table, with ``rank``: the first ``top`` rows of each language.

    The score that a language's first rows reach is read from counts by thousandths of the greatest score, and tasks keep
    no more than ``top`` rows of a language, so that few rows are ranked whatever the number of candidates.
    """
    bins = scored.groupBy("lang", F.floor(F.col("score") / 1000).alias("bin")).count()
    upto = bins.withColumn("upto", F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)))
    cuts = save(upto.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= top, F.col("bin"))), F.lit(0)).alias("cut")), "cuts")
    if cuts.count() <= 100_000:
        cuts = F.broadcast(cuts)
    near = scored.join(cuts, "lang").filter(F.col("score") >= F.col("cut") * 1000).drop("cut")
    names = near.columns
    lang, phrase, a, score = (names.index(n) for n in ("lang", "phrase", "a", "score"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(rows: list[tuple]) -> list[tuple]:
            rows.sort(key=lambda r: (r[lang], -r[score], -r[a], r[phrase].encode()))
            seen: Counter[str] = Counter()
            out = []
            for r in rows:
                seen[r[lang]] += 1
                if seen[r[lang]] <= top:
                    out.append(r)
            return out

        rows: list[tuple] = []
        kept = 0
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(rows) > 2 * kept + 50_000:
                rows = best(rows)
                kept = len(rows)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*best(rows), strict=True), batch.schema.types, strict=True)], names=names)

    shape = ", ".join(f"{n} {t}" for n, t in near.dtypes)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return near.mapInArrow(keep, shape).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, max_words: int = MAX_WORDS, max_symbols: int = MAX_SYMBOLS, chunk: int = CHUNK) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of the cut of least score (of equal ones the first), ``n`` the words
    of the language; the score is floor(2000000 a / (l + r)). Null languages are ``und``. Null and empty texts have no
    words; texts are read whole, a piece of any length included; repeated rows count each; ties are ordered by count,
    then by phrase in byte order. An empty table gives an empty result; other columns are left out.
    """
    texts = pick(docs, lang=lang, text=text).filter(F.col("text").isNotNull()).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    levels, totals = count_levels(texts, min_count, max_words, max_symbols, chunk)
    scored = save(score_candidates(levels), "scored")
    ranked = first_of_each(scored, top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents."""
    return mine_phrases(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
), counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
inner_parts AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS phrase
  FROM candidates WHERE m > 2
), around AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY lang, phrase),
left_over AS (
  SELECT c.* FROM candidates c LEFT JOIN around a ON a.lang = c.lang AND a.phrase = c.phrase WHERE a.f IS NULL OR 100 * a.f < 80 * c.f
), cuts AS (
  SELECT lang, m, phrase, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM left_over)
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.f // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
