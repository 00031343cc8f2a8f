"""A corpus pipeline of the training-data operators: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again by the next
one. Stages filter or change rows and keep the columns of documents; the last returns token counts and digests.
Rows with null texts or ids pass through every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import bpe, decontamination, neardup, secrets, toxicity
from postlake.llm.common import written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below a half. The model learns from the labels of those documents that are here, without the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(spark, model, F.col("text")) < 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return neardup.deduplicated(docs, n=5, least=(4, 5))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets of their texts replaced and n_chars counted anew."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of token ids of each document, and digests of the ids and of what they decode to."""
    return bpe.digests(bpe.encode(docs, decoding=True))


STAGES = [("toxicity", not_toxic), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("secrets", without_secrets), ("byte_bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
