"""Table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vocab as V
from ..operators.windows import latest_per_group
from ..session import cut_lineage


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Full overwrite; the commit protocol makes the new content visible at once."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_tenant(df: DataFrame, path: str) -> None:
    """Overwrites only the tenants present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)


def chunk_rows(df: DataFrame, size: int = V.SHEET_BLOCK_ROWS, row: str = "row_no", first: int = 2) -> DataFrame:
    """Contiguous blocks of rows for block-wise writing; a block never exceeds ``size`` rows."""
    cols = [c for c in df.columns if c != row]
    return (
        df.withColumn("block", F.floor((F.col(row) - first) / size).cast("int"))
        .groupBy("block").agg(F.min(row).alias("first_row"), F.count(F.lit(1)).alias("n_rows"),
                              F.array_sort(F.collect_list(F.struct(row, *cols))).alias("rows"))
    )


def upsert_log(log: DataFrame, new: DataFrame, keys: list[str], now: Column, ts: str = "ts", ttl: int = V.LOG_RETENTION_SECONDS) -> DataFrame:
    """Newest row per key of both tables, within the retention time."""
    merged = latest_per_group(log.unionByName(new, allowMissingColumns=True), keys, [ts])
    return merged.filter(F.unix_timestamp(ts) >= F.unix_timestamp(now) - ttl)


def write_diagnostics(path: str, **tables: DataFrame) -> None:
    """Unmatched rows, collisions and statistics beside the main output."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def reset_tenant(spark: SparkSession, path: str, tenant_id) -> None:
    """Drops one tenant's part of a table that ``write_tenant`` keeps; other tenants and a table that is not there stay as they are."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tenant_id={tenant_id}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def merge_log(new: DataFrame, path: str, keys: list[str], ts: str, part: str = "day") -> None:
    """Upsert rows into a log partitioned by the day of ``ts``: the latest row of each key and day stays, and only the days of ``new`` are rewritten.

    Rows without a time have a partition of their own.  A log that is not there yet is begun.
    """
    spark = new.sparkSession
    new = cut_lineage(new.withColumn(part, F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("none"))))
    days = new.select(part).distinct()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        # The join prunes the scan to the partitions of the new rows.
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(days), part, "left_semi")
        new = cut_lineage(old.select(new.columns).unionByName(new))
    rest = [c for c in new.columns if c not in (*keys, part)]
    order = F.struct(F.col(ts), *[F.col(c) for c in rest if c != ts])
    latest = new.groupBy(*keys, part).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*", part)
    latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
