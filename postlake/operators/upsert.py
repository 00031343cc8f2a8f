"""Writes as tables: merge of new rows, activation of a snapshot, overlays of what users applied to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.operators.dedup import first_per


def merged(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with new rows inserted and known ones updated. Of new rows with one key the first counts; null or empty values don't overwrite, zero and false do."""
    fresh = first_per(new, [key], F.col(order))
    kinds = dict(old.dtypes)
    value = lambda c: F.nullif(F.col(f"n.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"n.{c}")
    both = old.alias("o").join(fresh.alias("n"), key, "full_outer")
    return both.select(key, *(F.coalesce(value(c), F.col(f"o.{c}")).alias(c) for c in old.columns if c != key))


def activated(rows: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """rows with is_active as membership of the batch, unless the batch is empty."""
    marks = batch.select(key).distinct().withColumn("_in", F.lit(True))
    any_row = batch.agg((F.count("*") > 0).alias("_any"))
    return rows.join(marks, key, "left").crossJoin(F.broadcast(any_row)).withColumn("is_active", F.when(F.col("_any"), F.coalesce("_in", F.lit(False))).otherwise(F.col("is_active"))).drop("_in", "_any")


def applied(postings: DataFrame, applications: DataFrame) -> DataFrame:
    """postings with whether the user applied to them."""
    marks = applications.select("doc_id").distinct().withColumn("is_applied", F.lit(True))
    return postings.join(marks, "doc_id", "left").withColumn("is_applied", F.coalesce("is_applied", F.lit(False)))
