"""Document fingerprints: bottom-k sketches of word shingles, mergeable, from built-in functions alone.

A sketch is the sorted array of the ``k`` least 64-bit hashes of a text's distinct shingles.  The sketch of a union is the ``k`` least of both sketches, so
parts can be sketched apart and merged.  With fewer than ``k`` hashes it is the whole set and every estimate is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_cuts, bucket_of, let, whole, words

K = 128
SHINGLE = 5


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hash of each run of ``n`` words, in order; of the whole text if it has fewer words; none without words."""
    last = lambda w: F.greatest(F.size(w) - (n - 1), F.lit(1))
    runs = lambda w: F.transform(F.sequence(F.lit(1), last(w)), lambda i: F.xxhash64(F.slice(w, i, n)))
    return let(words(whole(text)), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<bigint>")))


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """Bottom-k sketch of a text; null and texts without words give the empty sketch."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, n))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of both shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard estimate: the share of the union's sketch that both hold; 1 for two empty sketches."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(merge(a, b, k), both))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) over the k-th hash's rank in the hash range."""
    rank = (F.element_at(s, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds; 1 if ``a`` is empty."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merged_sketch(rows: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """Sketch of the union of all sketches of a key, as (keys, column).

    Each hash is ranked within (key, hash slice) first, so that a hot key is spread over slices, and only ``k`` hashes of a slice go on.
    """
    one = rows.select(*keys, F.explode(column).alias("_h")).distinct().withColumn("_slice", F.pmod(F.shiftright("_h", 7), F.lit(64)))
    for part in ([*keys, "_slice"], keys):
        w = Window.partitionBy(*part).orderBy("_h")
        one = one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    got = one.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))
    return rows.select(*keys).distinct().join(got, keys, "left").withColumn(column, F.coalesce(column, F.array().cast("array<bigint>")))


def encode(s: Column) -> Column:
    """The sketch as a string: Base64 of its hashes, 8 bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def fingerprint_edits(docs: DataFrame, k: int = K, n: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    ``docs``: doc_id, text (others are ignored).  The next document is the one that follows in descending doc_id (null ids last, ties by text), the first
    one after the last; the edited text ends, instead of in its own last floor(n_chars / 3) code points, in as many of the next document's first, or all
    it has.  Null texts are empty; an empty text's sketch is empty and resembles only other empty sketches.  A lone document is its own next.
    Rows are cut into ranges of doc_id; inside a range the next row comes from a window, at its end from the head of the next range.
    """
    spark = docs.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", whole(F.col("text")).alias("text"))
    cuts = bucket_cuts(docs, "doc_id", F.xxhash64("doc_id"), buckets)
    # A range holds all rows of an id: only unlike ids are ordered.
    cuts = sorted(set(cuts))
    docs = docs.withColumn("bucket", bucket_of(F.col("doc_id"), cuts, docs.schema["doc_id"].dataType.simpleString(), F.lit(0)))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")

    # Heads: the first row of each range, for the last row of the range before it.  Ranges are as many as partitions allow, so these are few rows.
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    head = docs.join(tops, (docs["bucket"] == tops["bucket"]) & docs["doc_id"].eqNullSafe(tops["top"]), "left_semi")
    head = head.groupBy("bucket").agg(F.min("text").alias("head"))
    ring = tops.select("bucket", F.coalesce(F.lead("bucket").over(Window.orderBy(F.desc("bucket"))), F.max("bucket").over(Window.partitionBy())).alias("next"))
    head = ring.join(head.withColumnRenamed("bucket", "next"), "next").select("bucket", "head")

    def count(text):
        return F.length(text)

    rows = docs.withColumns({"next": F.lead("text").over(order), "n_chars": count(F.col("text")).cast("long")})
    rows = rows.withColumn("s", sketch(F.col("text"), k, n))
    rows = rows.withColumn("s_next", F.lead("s").over(order)).join(head, "bucket", "left")
    rows = rows.withColumn("next", F.coalesce("next", "head"))
    keep = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - keep), F.substr("next", F.lit(1), keep))
    rows = rows.withColumns({"edited": edited, "s_next": F.when(F.col("s_next").isNull(), sketch(F.col("head"), k, n)).otherwise(F.col("s_next"))})
    rows = rows.withColumn("e", sketch(F.col("edited"), k, n))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), encode(F.col("s")).alias("fingerprint"),
        encode(F.col("e")).alias("edited_fingerprint"), resemblance(F.col("s"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("s_next"), k).alias("near_next"), distinct_shingles(F.col("s"), k).alias("n_shingles"),
        containment(F.col("e"), F.col("s"), k).alias("edited_in_text"),
    )


def standard_error(j: float, k: int = K) -> float:
    """Standard error of a resemblance estimate."""
    return math.sqrt(j * (1 - j) / k)
