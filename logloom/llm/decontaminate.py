"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame expressions only.

1. Items are put in size classes by their number of shingles, each class spanning a power of two. The signature of an
   item is its shingles of least hash (a bottom-k MinHash sketch), and k follows from the upper end of its class: a
   document that contains such an item to 0.8 misses at most k - 1 shingles, so it holds one of the signature at least.
   The sketch is of the short side only, so a long document costs no recall.
2. The shingle hashes of the documents are joined with the signatures alone. Each signature row carries its class's
   least number of words, and a shorter document does not meet the class. The pairs that meet are the candidates.
3. The candidates alone are verified: the distinct shingles of the item that the document holds are counted, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import masked, pick, save, table

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Up to so many rows of signatures, item shingles or candidates are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def index_items(items: DataFrame, item: str = "item_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row for each distinct shingle of each item: item, shingle, its hash, its length in words, the item's count
    of shingles, its class (the logarithm of the count, rounded down), the least number of words of a document that
    contains an item of the class, and whether the shingle is in the signature.

    An item of fewer than five words is one shingle of its own length; one without words has no rows.
    """
    words = pick(items, item=item, text=text).select("item", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(SHINGLE_WORDS))
    spans = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    rows = words.select("item", length.alias("length"), F.explode(F.array_distinct(spans)).alias("s")).select("item", "length", F.array_join("s", " ").alias("shingle"), F.xxhash64("s").alias("hash")).distinct()
    counts = rows.groupBy("item", "length").agg(F.count("*").alias("size"))
    size_class = F.floor(F.log2(F.col("size"))).cast("int")
    sized = rows.join(counts, ["item", "length"]).withColumn("class", size_class)
    top = F.pow(F.lit(2.0), F.col("class") + 1) - 1  # the largest size of the class
    sketch = top - F.ceil(top * containment - 1e-9) + 1
    place = F.row_number().over(Window.partitionBy("item", "length").orderBy("hash", "shingle"))
    least = F.ceil(F.pow(F.lit(2.0), F.col("class")) * containment - 1e-9) + F.col("length") - 1
    return sized.withColumns({"least_words": least.cast("int"), "in_sketch": place <= sketch})


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def signature_meetings(words: DataFrame, index: DataFrame) -> DataFrame:
    """(key, item) for every shingle of a document (key, words) that is in the signature of an item, repeats included.

    Rows with a true column ``part`` are parts of a document, whose length is not known, so they meet items of any class.
    """
    part = F.col("part") if "part" in words.columns else F.lit(False)
    signatures = index.filter("in_sketch").select("item", "hash", "length", "least_words")
    lengths = [r[0] for r in index.select("length").distinct().orderBy("length").collect()]  # 1 to 5 at most
    if not lengths:
        return words.select("key", F.lit(None).alias("item")).filter("false")
    length = F.when(part, F.lit((1 << 31) - 1)).otherwise(F.size("words"))
    held = words.select("key", "words", F.size("words").alias("n_words"), length.alias("document_words"), F.explode(F.sequence(F.lit(1), F.size("words"))).alias("at"))
    if len(lengths) > 1:
        held = held.withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
    else:
        held = held.withColumn("length", F.lit(lengths[0]))
    held = held.filter("at + length - 1 <= n_words").select("key", "document_words", F.xxhash64(F.slice("words", F.col("at"), F.col("length"))).alias("hash"), "length")
    return held.join(small(signatures), ["hash", "length"]).filter("document_words >= least_words").select("key", "item")


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT, whole_rows: bool = False) -> DataFrame:
    """(key, item, containment): the items of whose distinct shingles a document holds 0.8 or more.

    Null texts have no words. Rows of the same key, null included, are parts of one document and hold an item together;
    with ``whole_rows`` they are known to be copies. Rows of the same item are one item with the shingles of all. Items with
    the same words are searched for once. Long texts are read whole. Empty tables on either side give an empty result. Other columns are
    left out.
    """
    named = pick(items, item=item, text=item_text).select("item", F.array_join(words_of(F.col("text")), " ").alias("text")).filter("text <> ''")
    bodies = named.groupBy("item").agg(F.sort_array(F.collect_set("text")).alias("texts")).withColumn("body", F.sha2(F.array_join("texts", "\n"), 256))
    same = save(bodies.select("item", "body"), "items")
    once = bodies.dropDuplicates(["body"]).select("body", F.explode("texts").alias("text"))
    index = save(index_items(once, "body", "text", containment), "index")
    rows = pick(docs, key=key, text=text)
    words = rows.select("key", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    if not whole_rows:
        parts = save(rows.groupBy("key").count().filter("count > 1").select(F.col("key").alias("several")), "parts")
        n = parts.count()
        if n:
            parts = F.broadcast(parts) if n <= BROADCAST_ROWS else parts
            words = words.join(parts.withColumn("part", F.lit(True)), F.col("key").eqNullSafe(F.col("several")), "left").select("key", "words", F.coalesce("part", F.lit(False)).alias("part"))
    pairs = save(signature_meetings(words, index).distinct(), "candidates").select(F.col("key").alias("met"), "item")
    # the shingles of the items go to the candidate documents, in which each is looked for between blanks
    shingles = index.groupBy("item", "length", "size").agg(F.collect_list("shingle").alias("shingles"))
    met = rows.join(small(pairs), F.col("key").eqNullSafe(F.col("met"))).join(small(shingles), "item")
    line = F.concat(F.lit(" "), F.array_join(words_of(F.col("text")), " "), F.lit(" "))
    each = met.select("key", "item", "size", "shingles", line.alias("line")).select("key", "item", "size", "line", F.explode("shingles").alias("shingle"))
    held = each.filter(F.contains(F.col("line"), F.concat(F.lit(" "), F.col("shingle"), F.lit(" ")))).select("key", "item", "size", "shingle").distinct()
    share = F.col("n") / F.col("size")
    found = held.groupBy("key", "item", "size").agg(F.count("*").alias("n")).filter(share >= containment - 1e-12)
    whole = found.select("key", F.col("item").alias("body"), share.alias("containment")).join(small(same), "body")
    return whole.select(F.col("key").alias(key), F.col("item").alias(item), "containment")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they contain."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


OP1_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k,
    unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM item_words WHERE len(w) > 0
), sizes AS (SELECT item_id, k, count(*) AS n FROM item_shingles GROUP BY ALL),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM doc_words, (SELECT DISTINCT k FROM item_shingles) WHERE len(w) >= k
)
SELECT d.doc_id, i.item_id, round(count(*) / any_value(n), 6) AS containment
FROM doc_shingles d JOIN item_shingles i ON d.s = i.s AND d.k = i.k JOIN sizes z ON z.item_id = i.item_id
GROUP BY d.doc_id, i.item_id HAVING count(*) / any_value(n) >= 0.8 - 1e-12
"""


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the documents that contain a benchmark item. What a document contains hangs on its text
    alone, so it is looked up by the text's digest; null ids and repeated rows need no care."""

    def stage(d: DataFrame) -> DataFrame:
        marked = d.withColumn("_text_key", F.sha2(F.coalesce("text", F.lit("")), 256))
        found = contained_items(marked, table(spark, sf_dir, "benchmark"), key="_text_key", whole_rows=True).select("_text_key").distinct()
        return marked.join(found, "_text_key", "left_anti")

    return masked(stage, docs, ("text",))
