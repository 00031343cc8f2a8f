"""Exact top-k search by inner product with a pivot-distance index (operator 10).

Vectors get one more component that gives all the same length (the largest there is), queries get zero there;
then the largest inner products are the smallest distances. A vector is keyed by its nearest pivot and its
distance from it. Distances by pivot are cut into rings, and a ring of many vectors into blocks, so that a block
holds about CELL vectors, however many are alike. A query first searches one block near its own key, which gives
a bound for its k-th score. By the triangle inequality, a vector that beats the bound has a distance from its
pivot that differs from the query's by no more than the bound's radius; so the query goes only to blocks whose
ring such distances reach. A block sorted by distance is expanded in annuli of STEP vectors for a group of
queries with like distances, from their own distance to both sides; in each annulus only those queries take part
whose bound it can beat, their bounds rise as they go, and the group stops where none has an annulus left.
Scores are exact integers; bounds are widened by SLACK for rounding.

Pivots come from k-means on SAMPLE vectors at most (those whose hashed ids come first); every vector is indexed.
What passes through the driver are the sample, at most SIDE pivots for each vector length and a row for each of
their at most SIDE * SIDE rings, whatever the table's size. A block gets a copy for each QUERIES queries that ask
it, and none if no query does.

Defined results: vectors that are null, or hold a null, infinite or NaN component, and rows without an id take
no part; a vector is compared with vectors of its own length, the empty one too; each row is a candidate of all
others, rows that repeat its id or vector included, and each row that asks has its own results; ties go to the
smaller id; an empty table gives an empty table; only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import forget, written

SAMPLE, CELL, QUERIES, STEP, SIDE, SLACK = 2000, 4096, 2048, 512, 256, 1e-6
GROUP, EXACT = 256, 2.0**53
ROUNDS = 8


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null if any is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that gives them the common length."""
    x = x.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def means(x: np.ndarray, k: int) -> np.ndarray:
    """k-means centres of the rows of x, from a fixed start."""
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(x, centres).argmin(axis=1)
        centres = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c for j, c in enumerate(centres)])
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


class Pivots:
    """For each vector length: the greatest squared norm, pivots, and the outer edges of each pivot's rings but the last."""

    def __init__(self, longest: dict[int, float], samples: dict[int, np.ndarray], side: int):
        self.longest, self.pivots, self.edges = longest, {}, {}
        for size, norm in longest.items():
            x = lifted(samples[size], norm) if size in samples else np.zeros((1, size + 1))
            self.pivots[size] = means(x, side)
            d = distances(x, self.pivots[size])
            near, least = d.argmin(axis=1), d.min(axis=1)
            self.edges[size] = [np.quantile(least[near == j], np.arange(1, side) / side) if (near == j).any() else np.zeros(side - 1) for j in range(len(self.pivots[size]))]

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot, ring and distance of vectors of one length."""
        d = distances(lifted(x, self.longest[x.shape[1]]), self.pivots[x.shape[1]])
        pivot = d.argmin(axis=1)
        least = d[np.arange(len(d)), pivot]
        return pivot, np.array([np.searchsorted(self.edges[x.shape[1]][p], v) for p, v in zip(pivot, least, strict=True)], np.int64), least


def by_size(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length in a column."""
    lists = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    sizes = np.array([len(v) for v in lists], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, np.array([lists[i] for i in at], np.int64).reshape(len(at), size)


def keyed(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """vectors (row, id, v) with the length, pivot, ring and distance that key them."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in by_size(batch.column(2)):
                pivot, ring, d = sent.value.keys(x)
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(at), size), pa.int32()), pa.array(pivot, pa.int32()), pa.array(ring, pa.int32()), pa.array(d)], ["row", "id", "v", "size", "pivot", "ring", "d"])

    return vectors.select("row", "id", "v").mapInArrow(keys, "row long, id long, v array<long>, size int, pivot int, ring int, d double")


def requests(queries: DataFrame, cells: list, pivots: Pivots, first: bool) -> DataFrame:
    """The blocks that each query (row, id, v, bound) goes to: at first one near its key, then all that can hold a better vector than its bound."""
    by: dict[int, list] = {}
    for c in cells:
        by.setdefault(c.size, []).append(c)
    sent = queries.sparkSession.sparkContext.broadcast((pivots, {s: tuple(np.array([getattr(c, f) for c in x]) for f in ("pivot", "lo", "hi", "ring", "blocks")) for s, x in by.items()}))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rings = sent.value
        for batch in batches:
            for size, at, x in by_size(batch.column(2)):
                pivot, lo, hi, ring, blocks = rings[size]
                some = max(1, (1 << 20) // len(pivot))  # so many queries meet all rings at once
                for start in range(0, len(x), some):
                    part, own = x[start : start + some], at[start : start + some]
                    q = np.concatenate([part.astype(float), np.zeros((len(part), 1))], axis=1)
                    d = distances(q, index.pivots[size])[:, pivot]
                    gap = np.maximum(np.maximum(lo - d, d - hi), 0)
                    if first:
                        who, cell = np.arange(len(part)), np.where(gap == gap.min(axis=1, keepdims=True), d, np.inf).argmin(axis=1)
                        block = np.zeros(len(part), np.int64)
                    else:
                        radius = radii(part, index.longest[size], batch.column(3).take(pa.array(own)).to_numpy(zero_copy_only=False))
                        who, cell = np.nonzero(gap <= radius[:, None])
                        times = blocks[cell]
                        block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        who, cell = np.repeat(who, times), np.repeat(cell, times)
                    for i in range(0, len(who), 4096):
                        w, c = who[i : i + 4096], cell[i : i + 4096]
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(own[w])).columns, pa.array(d[w, c]), *(pa.array(v, pa.int32()) for v in (np.full(len(w), size), pivot[c], ring[c], block[i : i + 4096]))], ["row", "id", "v", "bound", "dq", "size", "pivot", "ring", "block"])

    return queries.mapInArrow(asked, "row long, id long, v array<long>, bound long, dq double, size int, pivot int, ring int, block int")


def radii(x: np.ndarray, longest: float, bound: np.ndarray) -> np.ndarray:
    """The distances within which a vector must lie to have at least the bound as its inner product; infinite without a bound."""
    known = ~np.isnan(bound.astype(float))
    norms = (x.astype(float) ** 2).sum(axis=1)
    square = norms + longest - 2 * np.where(known, bound, 0).astype(float)
    return np.where(known, np.sqrt(np.maximum(square, 0) + SLACK * (norms + longest + 1)), np.inf)


NONE = np.iinfo(np.int64).min


def matrix(column: pd.Series, wide: float) -> np.ndarray:
    """Vectors as rows; as floats where these hold all inner products exactly (none exceeds the greatest squared length)."""
    return np.stack(column.to_numpy()).astype(np.float64 if wide < EXACT else np.int64)


def searched(block: pd.DataFrame, asked: pd.DataFrame, longest: dict[int, float], k: int) -> pd.DataFrame:
    """The best vectors of a block for each query that asks it: up to k with scores that can still count."""
    names = ["query", "query_id", "vec_id", "row", "score"]
    if not len(block) or not len(asked):
        return pd.DataFrame([], columns=names)
    block, asked = block.sort_values("d", kind="stable"), asked.sort_values("dq", kind="stable")
    wide = longest[len(block["v"].iloc[0])]
    d, ids, rows, x = block["d"].to_numpy(), block["id"].to_numpy(), block["row"].to_numpy(), matrix(block["v"], wide)
    edges = np.append(np.arange(0, len(d), STEP), len(d))
    found = []
    for at in range(0, len(asked), GROUP):
        some = asked.iloc[at : at + GROUP]
        q, own, dq = matrix(some["v"], wide), some["row"].to_numpy(), some["dq"].to_numpy()
        bound = np.array([NONE if pd.isna(b) else int(b) for b in some["bound"]], np.int64)
        # of each query its best so far: scores, and places in the block, -1 for none
        best, place = np.full((len(q), k), NONE, np.int64), np.full((len(q), k), -1, np.int64)
        radius = radii(q, wide, np.where(bound == NONE, np.nan, bound))
        right = int(np.searchsorted(edges[1:-1], np.searchsorted(d, np.median(dq)), "right"))
        left = right - 1
        while True:
            # annuli to both sides as far as some query's radius reaches; the nearer one first
            gap_left = np.maximum(dq - d[edges[left + 1] - 1], 0) if left >= 0 else np.full(len(q), np.inf)
            gap_right = np.maximum(d[edges[right]] - dq, 0) if right < len(edges) - 1 else np.full(len(q), np.inf)
            can_left, can_right = (gap_left <= radius) & (left >= 0), (gap_right <= radius) & (right < len(edges) - 1)
            if not can_left.any() and not can_right.any():
                break
            to_left = can_left.any() and (not can_right.any() or gap_left[can_left].min() <= gap_right[can_right].min())
            a = left if to_left else right
            left, right = (left - 1, right) if to_left else (left, right + 1)
            lo, hi = edges[a], edges[a + 1]
            take = np.flatnonzero((np.maximum(np.maximum(d[lo] - dq, dq - d[hi - 1]), 0)) <= radius)
            if not len(take):
                continue
            scores = (q[take] @ x[lo:hi].T).astype(np.int64)
            scores[(scores < bound[take, None]) | (rows[None, lo:hi] == own[take, None])] = NONE
            some_good = np.flatnonzero((scores > NONE).any(axis=1))
            columns = np.flatnonzero((scores > NONE).any(axis=0))
            take, scores = take[some_good], scores[np.ix_(some_good, columns)]
            both = np.concatenate([best[take], scores], axis=1)
            spots = np.concatenate([place[take], np.broadcast_to(columns + lo, scores.shape)], axis=1)
            order = np.lexsort((np.where(spots >= 0, ids[spots], 0), -np.maximum(both, NONE + 1)), axis=1)[:, :k]
            best[take], place[take] = np.take_along_axis(both, order, 1), np.take_along_axis(spots, order, 1)
            bound[take] = np.maximum(bound[take], best[take, -1])
            radius[take] = radii(q[take], wide, np.where(bound[take] == NONE, np.nan, bound[take]))
        who, which = np.nonzero(best > NONE)
        spot = place[who, which]
        found.append(pd.DataFrame({"query": own[who], "query_id": some["id"].to_numpy()[who], "vec_id": ids[spot], "row": rows[spot], "score": best[who, which]}))
    return pd.concat(found, ignore_index=True)


FOUND = "query long, query_id long, vec_id long, row long, score long"


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row for which ``queries`` (a column of vectors) is true, against all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.max(square).alias("longest"), F.count("*").alias("n")).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    side = min(SIDE, max(1, round((sum(s.n for s in sizes) / cell) ** 0.5)))
    sample: dict[int, list] = {}
    for r in rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        sample.setdefault(len(r.v), []).append(r.v)
    longest = {s.size: float(s.longest) for s in sizes}
    pivots = Pivots(longest, {s: np.array(v, np.int64) for s, v in sample.items()}, side)

    indexed = written(keyed(rows, pivots), "index")
    cells = indexed.groupBy("size", "pivot", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.ceil(F.count("*") / cell).cast("long").alias("blocks")).collect()
    counts = spark.createDataFrame([(c.size, c.pivot, c.ring, c.blocks) for c in cells], "size int, pivot int, ring int, blocks long")
    place = ["size", "pivot", "ring", "block"]
    blocks = indexed.join(F.broadcast(counts), ["size", "pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    tables = [rows, indexed]

    def best(asking: DataFrame, first: bool) -> DataFrame:
        asked = written(requests(asking, cells, pivots, first), "requests")
        tables.append(asked)
        copies = asked.groupBy(*place).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
        own = blocks.join(copies, place).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        dealt = asked.join(copies, place).withColumn("part", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int")).drop("copies")
        return own.groupBy(*place, "part").cogroup(dealt.groupBy(*place, "part")).applyInPandas(lambda b, a: searched(b, a, longest, k), FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("rank") <= k)

    asking = rows.where("asks").select("row", "id", "v", F.lit(None).cast("long").alias("bound"))
    near = written(best(asking, True), "near")
    bounds = ranked(near).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("least"))
    bounded = asking.join(bounds, "row", "left").select("row", "id", "v", F.col("least").alias("bound"))
    result = written(ranked(best(bounded, False)).select("query_id", "rank", "vec_id", "score"), "top")
    forget(*tables, near)
    return result


def op10_pivot_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of all other rows for each row whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
