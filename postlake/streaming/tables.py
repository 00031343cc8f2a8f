"""Tables that micro-batches write: a ledger, which a repeated batch doesn't change, and a table merged when it is read.

Both are plain Parquet folders. A batch writes under its own number and overwrites what an earlier try of it left, so
each batch counts once however often it is run. What a batch writes is its own rows and no others.

The merged table: each batch's rows go to ``delta/batch=N/bucket=M``, by a hash of their key. Reading takes the newest
row of each key from the base and the batches after it. ``compact`` writes a new base of all that is there and then a
line of the manifest; until that line is there, readers use the base before. ``vacuum`` removes what no reader of the
newest manifest needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


# ---- ledger


def ledger(path: str, entries: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch's entries (audit lines, alerts) to a ledger once."""

    def write(batch: DataFrame, number: int) -> None:
        entries(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All entries with their batch; none before the first batch."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(path)


def replaced(rows: DataFrame, path: str, by: str) -> None:
    """Delete-then-insert: the partitions of ``by`` that rows have are replaced by them, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


# ---- merged when read


def deltas(path: str, key: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's rows to the table at ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/delta/batch={number}")

    return write


def numbers(spark: SparkSession, path: str, folder: str, name: str) -> list[int]:
    """The numbers of a folder's partitions ``name``."""
    fs, where = filesystem(spark, f"{path}/{folder}")
    found = [s.getPath().getName().partition("=") for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(number) for part, _, number in found if part == name)


def base_of(spark: SparkSession, path: str) -> int:
    """The last batch that the newest base holds; -1 without a base."""
    if not exists(spark, f"{path}/manifest"):
        return -1
    return spark.read.schema("upto int").parquet(f"{path}/manifest").agg(F.max("upto")).first()[0]


def current(spark: SparkSession, path: str, key: str, *order: Column) -> DataFrame:
    """The newest row of each key by ``order`` (ascending), of equal ones that of the later batch. Rows without a key are one key."""
    upto = base_of(spark, path)
    parts = []
    new = [n for n in numbers(spark, path, "delta", "batch") if n > upto]
    if new:
        parts.append(spark.read.option("basePath", f"{path}/delta").parquet(*(f"{path}/delta/batch={n}" for n in new)))
    if upto >= 0:
        parts.append(spark.read.parquet(f"{path}/base/upto={upto}").withColumn("batch", F.lit(-1)))
    if not parts:
        raise ValueError(f"no batch has been written to {path}")
    rows = parts[0].select(sorted(parts[0].columns)) if len(parts) == 1 else parts[0].unionByName(parts[1])
    kept = [c for c in rows.columns if c not in ("bucket", "batch", key)]
    newest = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*kept), F.struct(*order, "batch")).alias("_r"))
    return newest.select(key, "_r.*", "bucket")


def compact(spark: SparkSession, path: str, key: str, *order: Column) -> None:
    """A new base of everything that is there; a table without new batches stays as it is."""
    upto = max(numbers(spark, path, "delta", "batch"), default=-1)
    if upto > base_of(spark, path):
        current(spark, path, key, *order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/upto={upto}")
        spark.createDataFrame([(upto,)], "upto int").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes bases before the newest and batches that it holds."""
    upto = base_of(spark, path)
    gone = [f"base/upto={n}" for n in numbers(spark, path, "base", "upto") if n < upto] + [f"delta/batch={n}" for n in numbers(spark, path, "delta", "batch") if n <= upto]
    for part in gone:
        delete(spark, f"{path}/{part}")
