"""Postings whose vectors are alike: a search for a stated query set, and an exact join of all rows within some days.

Vectors that are null, empty or hold a null or a number that isn't finite take no part, nor do rows without an id (or,
where days count, without a time). Vectors are compared with those of their own length only; a vector of zeros is like
nothing, not even itself.

The join compares distinct vectors once, wherever their rows lie, and deals them to cells so that each pair at the
threshold meets in one place:

1. Angle: a few vectors of the table are pivots, and each vector belongs to its nearest. Two vectors within the angle a
   (that of the threshold) differ by a at most in their angle to any pivot. So if i is nearest to pivot p, then j's
   angle to p is at most 2a more than to its own nearest pivot: j is sent to those pivots only.
2. Rings: within a pivot the angles to it are cut into rings of width a; a pair lies in one ring or in neighbours.
3. The vector of the smaller id stays in its cell; the other is copied to each cell where a partner can be. There are
   as many pivots as keep the copies few in a sample: where vectors lie in clusters many, else one. Cells of many
   vectors are cut into blocks, and each pair of blocks is a task's group, so no group grows with the table.
4. Rows join by pairs of vectors and cells of ``days`` days: the later of two rows is in the earlier one's cell or the
   next one.

Vectors without clusters (random ones in many dimensions) are all compared, whatever the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.staging import staged

PIVOTS, BLOCK, COPIES = 64, 16384, 8
#: Rows of a block that are multiplied with another block at once.
SLICE = 256
EPS = 1e-6


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *more: str) -> DataFrame:
    """(id, v, more) of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & (F.size(v) > 0) & finite).select(F.col(key).alias("id"), v.alias("v"), *more)


def units(column: pa.Array, n: int) -> np.ndarray:
    """Vectors of one length as rows of a matrix, each of length 1 or all zero."""
    x = np.asarray(column.flatten(), np.float64).reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def met_queries(batch: pa.RecordBatch, by: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of queries (for each length of vectors ids and unit vectors) and rows (id, v), SLICE rows at a time, so a task holds one slice's products whatever the batch."""
    sizes = batch.column(1).value_lengths().to_numpy()
    for size in np.unique(sizes):
        if int(size) in by:
            whole = batch.filter(pa.array(sizes == size))
            ids, q = by[int(size)]
            for part in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                own, x = part.column(0).to_numpy(), units(part.column(1), part.num_rows)
                cosine = q @ x.T
                i, j = np.nonzero((cosine >= least) & (ids[:, None] != own[None, :]) & x.any(axis=1)[None, :] & q.any(axis=1)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), pa.array(cosine[i, j])], ["vec_id", "other_id", "similarity"])


def search(vectors: DataFrame, queries: Column, least: float, block: int = 2048) -> DataFrame:
    """(vec_id, other_id, similarity) of each row for which ``queries`` is true and all rows of other ids whose cosine is at least ``least``. The query set meets all rows a block at a time; each block's result is written before the next block is read, so the driver, a task and the plan hold one block."""
    rows = usable(vectors)
    asking = usable(vectors.where(queries))
    blocks = max(1, -(-asking.count() // block))
    found = []
    for b in range(blocks):
        some = asking.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(r.v) for r in some}:
            own = [r for r in some if len(r.v) == size]
            x = np.array([r.v for r in own])
            by[size] = (np.array([r.id for r in own], np.int64), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))

        def met(batches: Iterator[pa.RecordBatch], by: dict = by) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from met_queries(batch, by, least)

        part = rows.mapInArrow(met, "vec_id long, other_id long, similarity double")
        found.append(part if blocks == 1 else staged(part, "search"))
    return reduce(DataFrame.unionByName, found)


def near(x: np.ndarray, pivots: np.ndarray, angle: float) -> tuple[int, int, list[tuple[int, int]]]:
    """The nearest pivot, the ring in it, and the pivots and rings where a partner can be."""
    a = np.arccos(np.clip(pivots @ (x / max(np.linalg.norm(x), 1e-300)), -1, 1))
    own = int(a.argmin())
    there = np.flatnonzero(a <= a[own] + 2 * angle + EPS)
    return own, int(a[own] // angle), [(int(i), r) for i in there for r in range(int(max(a[i] - angle - EPS, 0) // angle), int((a[i] + angle + EPS) // angle) + 1)]


def pivots_of(rows: DataFrame, angle: float, most: int, copies: int = COPIES) -> dict[int, np.ndarray]:
    """For each length of vectors its pivots: the most, up to ``most``, that copy a vector of the sample ``copies`` times at most in the mean, or one. The sample is the first by a hash of ids, 4 * most of them; any choice gives the same pairs."""
    by: dict[int, list[np.ndarray]] = {}
    for r in rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id")).limit(4 * most).collect():
        x = np.array(r.v, np.float64)
        by.setdefault(len(x), []).append(x / np.linalg.norm(x))
    out = {}
    for size, x in by.items():
        fits = [m for m in (2**e for e in range(1, 11)) if m <= min(most, len(x)) and np.mean([len(near(v, np.array(x[:m]), angle)[2]) for v in x]) <= copies]
        out[size] = np.array(x[: max(fits, default=1)])
    return out


def placed(rows: DataFrame, pivots: dict[int, np.ndarray], angle: float) -> DataFrame:
    """(id, v, size, own, home, rings): the nearest pivot and the ring in it, and the pivots and rings where a partner can be."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a length that no pivot has is one cell
            out = [near(x, pivots.get(len(x), np.zeros((1, len(x)))), angle) for x in (np.array(v.as_py(), np.float64) for v in batch.column(1))]
            columns = [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([[{"p": p, "ring": r} for p, r in o[2]] for o in out], pa.list_(pa.struct([("p", pa.int32()), ("ring", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["id", "v", "own", "home", "rings"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(dealt, f"id long, v {kind}, own int, home int, rings array<struct<p: int, ring: int>>").withColumn("size", F.size("v"))


def alike(vectors: DataFrame, least: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows (id, v) whose cosine is at least ``least``."""
    angle = float(max(np.arccos(least), 1e-3))
    cells = staged(placed(vectors.select("id", "v"), pivots_of(vectors, angle, pivots), angle), "placed")
    names = ["size", "p", "ring"]
    left = cells.select("id", "v", "size", F.col("own").alias("p"), F.col("home").alias("ring"))
    right = cells.select("id", "v", "size", F.inline("rings"))
    # only cells where both sides have rows; large ones in blocks
    blocks = lambda df, k: df.groupBy(*names).agg(F.ceil(F.count("*") / block).cast("int").alias(k))
    sizes = staged(blocks(left, "k").join(blocks(right, "k2"), names), "cells")
    part = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = left.join(sizes, names).select(*names, "id", "v", part("k").alias("s"), every("k2").alias("s2"))
    b = right.join(sizes, names).select(*names, "id", "v", part("k2").alias("s2"), every("k").alias("s"))
    b = b.toDF(*b.columns)  # columns of its own, which a's aren't taken for

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, others = x["id"].to_numpy(), y["id"].to_numpy()
        found = []
        if len(ids) and len(others):
            u, w = (units(t["v"].combine_chunks(), t.num_rows) for t in (x, y))
            for at in range(0, len(ids), SLICE):
                cosine = u[at : at + SLICE] @ w.T
                i, j = np.nonzero(cosine >= least)
                i, j = (k[ids[at + i] < others[j]] for k in (i, j))
                found.append((ids[at + i], others[j], cosine[i, j]))
        a, b, c = (np.concatenate(k) for k in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "similarity": c})

    keys = [*names, "s", "s2"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(met, "a long, b long, similarity double")


def within_days(vectors: DataFrame, time: str, key: str = "vec_id", vector: str = "embedding", least: float = 0.92, days: int = 14, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id, other_id, similarity), id < other_id: all pairs of rows whose times are ``days`` days apart at most and whose cosine is at least ``least`` (above 0)."""
    if not 0 < least <= 1:
        raise ValueError("the threshold is a cosine above 0")
    span = days * 86400 * 1_000_000
    rows = usable(vectors.where(F.col(time).isNotNull()), key, vector, F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    classes = staged(rows.where(F.exists("v", lambda x: x != 0)).groupBy("v").agg(F.min("id").alias("id")), "vectors")
    found = staged(alike(classes, least, pivots, block), "alike")
    same = classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    pairs = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(same)
    each = staged(rows.join(classes.select("v", F.col("id").alias("c")), "v").select("id", "at", "c", F.floor(F.col("at") / span).alias("day")), "rows")
    first = each.select(F.col("c").alias("a"), "id", "at", "day")
    later = each.select(F.col("c").alias("b"), F.col("id").alias("id2"), F.col("at").alias("at2"), F.explode(F.array(F.col("day"), F.col("day") - 1)).alias("day"))
    met = first.join(pairs, "a").join(later, ["b", "day"])
    order = (F.col("at") < F.col("at2")) | ((F.col("at") == F.col("at2")) & (F.col("id") < F.col("id2")))
    both = met.where(order & (F.col("at2") - F.col("at") <= span) & (F.col("id") != F.col("id2")))
    return both.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("other_id"), "similarity")
