"""Vectors against brute force: odd rows, blocks, cells of time and angle."""

import datetime as dt
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.operators import semantic

KIND = "vec_id long, embedding array<float>, t timestamp, p int, day string"
START = dt.datetime(2024, 1, 1)


def corpus(seed, n, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = []
    for i in range(n):
        x = centres[rng.integers(5)] + rng.normal(size=dims) * rng.choice([0.05, 0.4, 2.0])
        rows.append((i, [float(np.float32(v)) for v in x], START + dt.timedelta(hours=int(rng.integers(0, 24 * 70)))))
    day = START + dt.timedelta(days=5)
    odd = [(900, [1.0, 2.0], day), (901, [1.0, 2.0], day), (902, [], day), (903, None, day), (904, [float("nan")] * dims, day), (905, [0.0] * dims, day), (906, [0.0] * dims, day), (None, rows[0][1], day), (907, rows[0][1], None), (908, [None, 1.0], day), (909, [float("inf")] * dims, day), (910, rows[1][1], rows[1][2] + dt.timedelta(days=14)), (911, rows[1][1], rows[1][2] + dt.timedelta(days=14, seconds=1))]
    return rows + odd


def good(r):
    return r[0] is not None and bool(r[1]) and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(3)


@pytest.mark.parametrize(("seed", "least", "pivots", "block"), [(1, 0.92, 16, 1024), (2, 0.92, 3, 5), (3, 0.5, 4, 16), (4, 0.99, 1, 1024)])
def test_all_pairs_within_the_days_are_found_once(spark, seed, least, pivots, block):
    rows = corpus(seed, 130)
    part = [r for r in rows if good(r) and r[2] is not None]
    want = {(a[0], b[0]) for a in part for b in part if a[0] < b[0] and len(a[1]) == len(b[1]) and abs(a[2] - b[2]) <= dt.timedelta(days=14) and cosine(a[1], b[1]) >= least}
    got = semantic.within_days(frame(spark, rows), "t", least=least, pivots=pivots, block=block).collect()
    assert {(r.id, r.other_id) for r in got} == want and len(got) == len(want)
    assert (1, 910) in want and (1, 911) not in want and (900, 901) in want


def test_a_hot_vector_on_one_day(spark):
    rows = [(i, [1.0, 0.0, float(i == 7)], START) for i in range(60)]
    got = semantic.within_days(frame(spark, rows), "t", block=9).collect()
    assert {(r.id, r.other_id) for r in got} == {(i, j) for i in range(60) for j in range(i + 1, 60) if 7 not in (i, j)}


def test_search_defines_odd_vectors(spark):
    rows = corpus(6, 60)
    part = [r for r in rows if good(r)]
    want = {(a[0], b[0]) for a in part for b in part if a[0] % 3 == 0 and a[0] != b[0] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.4}
    for block in (4, 2048):
        got = semantic.search(frame(spark, rows), F.col("vec_id") % 3 == 0, 0.4, block=block).collect()
        assert {(r.vec_id, r.other_id) for r in got} == want and len(got) == len(want)


def test_empty(spark):
    assert semantic.within_days(spark.createDataFrame([], KIND), "t").count() == 0
    assert semantic.search(spark.createDataFrame([], KIND), F.lit(True), 0.5).count() == 0


def test_a_search_holds_one_slice_of_products():
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(10_000, 16)), rng.normal(size=(1_000, 16))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(list(rows.astype(np.float32)), pa.list_(pa.float32()))], ["id", "v"])
    want = int((queries @ (rows.astype(np.float32) / np.linalg.norm(rows.astype(np.float32), axis=1, keepdims=True)).T >= 0.8).sum())
    tracemalloc.start()
    got = sum(b.num_rows for b in semantic.met_queries(batch, {16: (np.arange(20_000, 21_000), queries)}, 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want > 0 and peak < 30e6  # all products at once are 80 MB
