import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postlake import bindings as B
from postlake.operators import analytics, dedup, upsert
from postlake.streaming import health, tables

DATA = "/root/testdata/sf0.001"


def landed(spark, tmp_path):
    runs = B.runs(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    for i in range(3):
        runs.where(F.col("run_id") % 3 == i).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_windows_equal_batch(spark, tmp_path):
    stream = landed(spark, tmp_path)
    q = health.windowed(stream, late="400 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.source, str(r.window.start)[:10]): (r.runs, r.failed) for r in spark.table("w").collect()}
    batch = B.runs(spark, DATA).groupBy("source", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("f")).collect()
    assert got == {(r.source, str(r.d)): (r.n, r.f) for r in batch}


def test_health_state_equals_batch(spark, tmp_path):
    runs = B.runs(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    runs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "in"))
    q = health.source_health(stream).writeStream.format("memory").queryName("h").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.source: (r.failures, r.status) for r in analytics.with_status(dedup.running_failures(B.runs(spark, DATA))).collect()}
    assert {r.source: (r.failures, r.status) for r in spark.table("h").collect()} == want


def test_upserts_by_batch(spark, tmp_path):
    kind = "k string, a string, seq int"
    merge = lambda old, new: upsert.merged(old if old is not None else new.limit(0), new, "k", "seq")
    write = health.upserting(str(tmp_path / "t"), merge)
    write(spark.createDataFrame([("x", "1", 0), ("y", "2", 0)], kind), 0)
    for _ in range(2):  # a batch that is run again changes nothing
        write(spark.createDataFrame([("x", "9", 1), ("z", "3", 1)], kind), 1)
    assert sorted((r.k, r.a) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()) == [("x", "9"), ("y", "2"), ("z", "3")]


@pytest.mark.parametrize(("seed", "late"), [(1, None), (2, None), (3, "400 days")])
def test_health_does_not_depend_on_order_or_batches(spark, tmp_path, seed, late):
    rng = random.Random(seed)
    rows = [(f"s{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(300)), i, rng.random() < 0.15) for i in range(90)]
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == s), key=lambda r: r[:2])
        want[s] = next((n for n, r in enumerate(reversed(own)) if r[2]), len(own))
    rng.shuffle(rows)
    kind = "source string, ts timestamp, run_id long, ok boolean"
    for i in range(3):
        spark.createDataFrame(rows[i * 30 : i * 30 + 30], kind).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = []
    q = health.source_health(stream, late).writeStream.foreachBatch(lambda b, n: out.extend((n, r.source, r.failures) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {s: f for _, s, f in sorted(out)} == want


def test_a_repeated_batch_adds_nothing_to_the_ledger(spark, tmp_path):
    path, kind = str(tmp_path / "ledger"), "source string, n int"
    assert tables.entries(spark, path, kind).count() == 0
    write = tables.ledger(path)
    write(spark.createDataFrame([("a", 1), ("a", 1)], kind), 0)
    for _ in range(2):
        write(spark.createDataFrame([("b", 2)], kind), 1)
    assert sorted(tuple(r) for r in tables.entries(spark, path, kind).collect()) == [("a", 1, 0), ("a", 1, 0), ("b", 2, 1)]


def test_a_stream_that_died_after_writing_writes_its_batch_again(spark, tmp_path):
    path, kind = str(tmp_path / "ledger"), "source string, n int"
    spark.createDataFrame([("a", 1), ("b", 2)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    write, died = tables.ledger(path), []

    def dying(batch, number):
        write(batch, number)
        if not died:
            died.append(number)
            raise RuntimeError("killed after the write, before the commit")

    def run():
        q = spark.readStream.schema(kind).parquet(str(tmp_path / "in")).writeStream.foreachBatch(dying).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert died == [0] and sorted(tuple(r)[:2] for r in tables.entries(spark, path, kind).collect()) == [("a", 1), ("b", 2)]


def test_merging_when_read_equals_merging_when_written(spark, tmp_path):
    rng = random.Random(4)
    path, kind = str(tmp_path / "t"), "k string, seq int, a string"
    write, want = tables.deltas(path, "k", 4), {}
    newest = lambda: {r.k: (r.seq, r.a) for r in tables.current(spark, path, "k", F.col("seq")).collect()}
    with pytest.raises(ValueError, match="no batch"):
        newest()
    for number in range(4):
        rows = [(rng.choice(["x", "y", "z", "w", None]), number * 10 + i, rng.choice(["1", None])) for i in range(4)]
        for _ in range(1 + number % 2):
            write(spark.createDataFrame(rows, kind), number)
        want |= {k: (seq, a) for k, seq, a in rows}
        assert newest() == want
        assert spark.read.parquet(f"{path}/delta/batch={number}").count() == len(rows)  # what a batch writes is its own rows
        if number == 1:
            tables.compact(spark, path, "k", F.col("seq"))
            tables.compact(spark, path, "k", F.col("seq"))
            tables.vacuum(spark, path)
            assert newest() == want and not (tmp_path / "t/delta/batch=0").exists()
    tables.compact(spark, path, "k", F.col("seq"))
    tables.vacuum(spark, path)
    assert newest() == want and sorted(p.name for p in (tmp_path / "t/base").iterdir() if "=" in p.name) == ["upto=3"]


def test_partitions_are_replaced(spark, tmp_path):
    path, kind = str(tmp_path / "m"), "cv_id int, doc_id int"
    tables.replaced(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], kind), path, "cv_id")
    tables.replaced(spark.createDataFrame([(1, 9)], kind), path, "cv_id")
    assert sorted((r.cv_id, r.doc_id) for r in spark.read.parquet(path).collect()) == [(1, 9), (2, 3)]
