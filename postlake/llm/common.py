"""What the training-data operators share: where intermediate tables go, and how hashes are taken."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters are lowered and nothing else; words are what these six characters of white space leave.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
LOWER_TABLE = str.maketrans(UPPER, LOWER)
WORD_BREAKS = str.maketrans(SPACE, " " * len(SPACE))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where that is unset, a temporary folder is made and set if all runs in one process on one machine; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="postlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"{base.rstrip('/')}/postlake-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for a while, then what it was before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: With this on, a query's shuffle files go when it ends; what it wrote is read from then on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there, and losing an executor loses none of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written() that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark._jvm
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            with contextlib.suppress(Exception):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few MB, so that a worker's memory doesn't follow the length of texts (a batch holds one row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key's text, modulo modulus; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words_of(text: str | None) -> list[str]:
    """Words of a text with A-Z lowered. str.split() with no argument would also break at other Unicode spaces."""
    return [w for w in (text or "").translate(LOWER_TABLE).translate(WORD_BREAKS).split(" ") if w]


def normal_words(text: Column) -> Column:
    """The words of words_of as one string with single spaces between, by built-in functions."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of whole numbers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= MIX1
        x ^= x >> np.uint64(27)
        x *= MIX2
        x ^= x >> np.uint64(31)
    return x
