"""Ordered-row operators that survive a key holding a large share of all rows.

A plain window sends a whole key to one task.  Where the order column is a
number or a timestamp the key is cut into fixed-width buckets of that column:
a first pass works inside (key, bucket), a second pass over one summary row per
bucket carries the state across bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Newest row per key by ``max_by``; combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*keys, "_m.*")
        .select(*df.columns)
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _bucketed(df: DataFrame, order: str, width: float) -> DataFrame:
    """``order`` is a number, or a time and then ``width`` means seconds."""
    col = F.col(order)
    if dict(df.dtypes)[order].startswith("timestamp"):
        col = F.unix_micros(col.cast("timestamp")) / 1000000
    return df.withColumn("_b", F.floor(col.cast("double") / width))


def carry_forward(df: DataFrame, col: str, keys: list[str], order: str, width: float, out: str,
                  tie: str | None = None) -> DataFrame:
    """Last non-null ``col`` at or before each row, per key."""
    ordering = [order] + ([tie] if tie else [])
    b = _bucketed(df, order, width)
    within = Window.partitionBy(*keys, "_b").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_local", F.last(col, ignorenulls=True).over(within))
    per_bucket = b.filter(F.col(col).isNotNull()).groupBy(*keys, "_b").agg(
        F.max_by(col, F.struct(*ordering)).alias("_last")
    )
    all_buckets = b.select(*keys, "_b").distinct().join(per_bucket, [*keys, "_b"], "left")
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = all_buckets.select(*keys, "_b", F.last("_last", ignorenulls=True).over(across).alias("_before"))
    return (
        local.join(before, [*keys, "_b"])
        .withColumn(out, F.coalesce("_local", "_before"))
        .drop("_b", "_local", "_before")
    )


def with_previous(df: DataFrame, cols: list[str], keys: list[str], order: str, width: float,
                  tie: str | None = None, prefix: str = "prev_") -> DataFrame:
    """The given columns of the row before, per key."""
    ordering = [order] + ([tie] if tie else [])
    b = _bucketed(df, order, width)
    within = Window.partitionBy(*keys, "_b").orderBy(*ordering)
    local = b.withColumn("_prev", F.lag(F.struct(*cols)).over(within))
    tails = b.groupBy(*keys, "_b").agg(F.max_by(F.struct(*cols), F.struct(*ordering)).alias("_tail"))
    before = tails.select(*keys, "_b", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_b")).alias("_before"))
    out = local.join(before, [*keys, "_b"]).withColumn("_p", F.coalesce("_prev", "_before"))
    return out.select(*df.columns, *[F.col(f"_p.{c}").alias(prefix + c) for c in cols])


def with_next(df: DataFrame, cols: list[str], keys: list[str], order: list[str], prefix: str = "next_") -> DataFrame:
    """The row after, for keys that are one message or one post and so stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({prefix + c: F.lead(c).over(w) for c in cols})


def numbered(df: DataFrame, keys: list[str], order: str, width: float, out: str = "rn",
             tie: str | None = None) -> DataFrame:
    """Row number per key: number inside the bucket plus the rows of earlier buckets."""
    ordering = [order] + ([tie] if tie else [])
    b = _bucketed(df, order, width)
    local = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*ordering)))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_off"))
    return (
        local.join(offset, [*keys, "_b"]).withColumn(out, F.col("_rn") + F.col("_off")).drop("_b", "_rn", "_off")
    )
