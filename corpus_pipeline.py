"""Training-data pipeline over ``documents``: each stage reads what the one before it wrote."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import decontam, langid, neardup, pieces, pii
from pricewell.llm.common import remove, shared_dir, table
from pricewell.llm.queries import piece_model


# Log-likelihood per trigram of a text whose trigrams fall on all buckets alike; a text below it fits the languages worse than no language at all.
LEAST_FIT = -math.log(langid.BUCKETS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the learned languages: texts without a letter go, and those that fit worse than ``LEAST_FIT``; if no language was learned, all with a letter stay."""
    langs, weights = langid.fit(docs, F.lit(True))
    if not langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, langs, weights).where((F.col("_lang_pred") != langid.UND) & (F.col("_fit") >= LEAST_FIT)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words."""
    return neardup.keep_one(docs, 5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with digests of the ids and of the text decoded from them."""
    return pieces.digest_documents(docs, piece_model(), with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", tokens),
]
# The stages are models and merges that SQL cannot state; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again; what a stage has read goes once it is written."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
