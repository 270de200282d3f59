"""Helpers of the training-data operators: word columns, ordered buckets, lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..session import shared_dir

__all__ = ["table", "whole", "words", "let", "ascii_lower", "cut_lineage", "shared_dir", "release", "bucket_cuts", "remove", "bucket_of", "least_hashed", "UPPER", "LOWER"]

SPACE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Sampled keys for each cut point, as many as Spark's own range partitioner takes.
SAMPLE_PER_CUT = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; the shuffle files it was made from go at once, not when the driver collects its garbage."""
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return session.cut_lineage(df)


def release(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames from ``cut_lineage`` that nothing reads any more."""
    for df in frames:
        at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if at.isDefined():
            remove(df.sparkSession, at.get())


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``; a plain reference would be inlined into each lambda."""
    return F.transform(F.array(value), body)[0]


def bucket_cuts(rows: DataFrame, key: str, salt: Column, buckets: int) -> list:
    """Sorted keys that cut ``rows`` into about equal ranges.

    A deterministic sample of ``SAMPLE_PER_CUT * buckets`` keys, those of the smallest hash, serves for partition bounds alone (its size follows the
    number of partitions, not of rows).  A key that fills several ranges appears several times.
    """
    size = SAMPLE_PER_CUT * buckets
    sample = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), salt.alias("s")).orderBy("s", "k").limit(size)
    keys = sorted(r.k for r in sample.collect())
    return [keys[len(keys) * i // buckets] for i in range(1, buckets)] if keys else []


def bucket_of(key: Column, cuts: list, kind: str, spread: Column) -> Column:
    """Number of cuts at or below ``key``, by binary search; null keys come first.

    Rows of one key that covers several ranges are dealt over these ranges by ``spread``, so that a hot key does not meet in one task.
    """
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]

    def search(holds):
        def step(at, jump):
            return F.when((at + jump <= len(cuts)) & holds(F.get(bounds, at + jump - 1)), at + jump).otherwise(at)

        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)

    def place(k):
        last = search(lambda c: c <= k)
        if len(set(cuts)) == len(cuts):
            return last
        # A key equal to cuts[first .. last-1] may stand in any of the ranges first+1 .. last.
        first = search(lambda c: c < k)
        return F.when(last - first > 1, first + 1 + F.pmod(spread, last - first).cast("int")).otherwise(last)

    return let(key, lambda k: F.when(k.isNull(), 0).otherwise(place(k)))


def least_hashed(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Of each group the ``n`` rows of the least hash of ``key``; a large group is cut into slices first, so that no task sees it whole."""
    rows = rows.withColumns({"_h": F.xxhash64(key), "_slice": F.pmod(F.xxhash64(key, F.lit(1)), F.lit(256))})
    for part in ([group, "_slice"], [group]):
        w = Window.partitionBy(*part).orderBy("_h", key)
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return rows.drop("_h", "_slice", "_n")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that this job wrote; one that is not there is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
