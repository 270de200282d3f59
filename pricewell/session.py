"""Session helpers: defaults for local runs and lineage cuts in the shared folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def get_spark(app: str = "pricewell", cpus: int | None = None, **conf) -> SparkSession:
    """A session for local work; on a cluster the submitted settings are kept."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cpus is not None:
        b = (
            b.master(f"local[{cpus}]")
            .config("spark.driver.memory", os.environ.get("PRICEWELL_DRIVER_MEMORY", "12g"))
            .config("spark.sql.shuffle.partitions", str(cpus))
        )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session, which has one machine, gets a folder of its own."""
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(CHECKPOINT_DIR, path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a costly map stage over an input of too few splits.

    Large inputs have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread_work(df: DataFrame) -> DataFrame:
    """Rows of few bytes but much work each: keep all shuffle partitions, which coalescing would merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefer_small_methods(spark: SparkSession) -> None:
    """The JVM leaves methods over 8000 bytes uncompiled; such stages run as split projections instead."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def built_once(fn):
    """For functions of names alone that return columns: the columns are made once for each JVM, as each takes hundreds of calls to it."""
    made: dict = {}

    @functools.wraps(fn)
    def get(*args):
        if not all(a is None or isinstance(a, (str, bool)) for a in args):
            return fn(*args)
        jvm = SparkContext._gateway
        if made.get("jvm") is not jvm:
            made.clear()
            made["jvm"] = jvm
        if args not in made:
            made[args] = fn(*args)
        return made[args]

    return get
