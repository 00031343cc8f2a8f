"""Benchmark decontamination by size-partitioned MinHash containment search (operator 5).

A short item's MinHash says little about a long document, whose other shingles hold most of the minima. So
items are partitioned by size: class c holds items of more than c/2 and up to c distinct shingles, for c a
power of two. For each class that has items, a document is covered by windows of 2c shingles, c apart; a
passage of up to c + 1 shingles lies whole in one of them. The minima of a window come from those of blocks,
and those of larger blocks from smaller ones, so each hash function passes over a document once. An item and a
window are candidates if any of ``HASHES`` minima are equal: an item of which 0.8 is in the window is missed
with a probability under 0.81 ** 64, about one in a million. A candidate is verified on the words themselves:
it is a hit if at least ``least`` of the item's shingles are among those of the whole document.

Items are broadcast in blocks whose size is checked, about BLOCK bytes of text at a time, and as many passes over
the documents are made as there are blocks. The driver holds one block at a time: of several, each pass is written
before the next block is read.

Defined results: items and documents with null or empty texts have no shingles and are in no pair; with fewer
words than a shingle has, the whole sequence is one shingle; repeated rows are reported each; null ids stay
null; only ids and texts are read; empty tables give an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import forget, mixed, small_batches, written
from postlake.llm.shingles import parts, shingle_set, shingle_sql, shingles

WORDS, LEAST = 5, (4, 5)
HASHES = 64
BLOCK = 16 << 20
MULTIPLY = (mixed(np.arange(1000, 1000 + HASHES, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
ADD = mixed(np.arange(5000, 5000 + HASHES, dtype=np.uint64)).astype(np.uint32)


class Items:
    """Items of one block: their shingle sets, and by size class the sorted minima of each hash function."""

    def __init__(self, texts: list[str | None], n: int):
        self.sets = [shingle_set(t, n) for t in texts]
        hashes, at = shingles(pa.array(texts, pa.string()), n)
        minima: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i in range(len(texts)):
            if at[i + 1] > at[i]:
                x = hashes[at[i] : at[i + 1]].astype(np.uint32)
                minima[1 << max(0, len(self.sets[i]) - 1).bit_length()].append((i, (MULTIPLY[:, None] * x + ADD[:, None]).min(axis=1)))
        self.classes = {}
        for size, found in sorted(minima.items()):
            ids, values = np.array([i for i, _ in found]), np.stack([m for _, m in found])
            order = np.argsort(values, axis=0, kind="stable")
            self.classes[size] = (np.take_along_axis(values, order, 0).T.copy(), ids[order].T.copy())


def candidates(column: pa.Array, items: Items, n: int) -> set[tuple[int, int]]:
    """(text, item) pairs with an equal minimum in one of the text's windows."""
    hashes, at = shingles(column, n)
    counts, found = np.diff(at), set()
    if not len(hashes) or not items.classes:
        return found
    x = hashes.astype(np.uint32)
    layout, below = {}, None
    for size in items.classes:  # blocks of each size, within texts: where they start among those of the size before
        blocks = -(-counts // size)
        first = np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(len(counts)), blocks)
        start = (np.arange(first[-1]) - first[text]) * size
        layout[size] = (text, at[text] + start if below is None else below[1][text] + start // below[0])
        below = (size, first)
    for h in range(HASHES):
        level = MULTIPLY[h] * x + ADD[h]
        for size, (values, ids) in items.classes.items():
            text, starts = layout[size]
            level = np.minimum.reduceat(level, starts)
            window = level.copy()
            same = text[:-1] == text[1:]
            window[:-1][same] = np.minimum(level[:-1], level[1:])[same]
            own = values[h]
            lo = np.searchsorted(own, window)
            hit = np.flatnonzero(own[np.minimum(lo, len(own) - 1)] == window)
            for w, a, b in zip(hit, lo[hit], np.searchsorted(own, window[hit], "right"), strict=True):
                found.update((int(text[w]), int(i)) for i in ids[h][a:b])
    return found


def hits(column: pa.Array, items: Items, n: int, least: tuple[int, int]) -> list[list[dict]]:
    """For each text the items of which enough is in it: their places and the number of shared shingles."""
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for start, stop in parts(column):
        own = None, set()
        for text, item in sorted(candidates(column.slice(start, stop - start), items, n)):
            if own[0] != text:
                own = text, shingle_set(column[start + text].as_py(), n)
            shared = len(items.sets[item] & own[1])
            if shared * least[1] >= least[0] * len(items.sets[item]):
                out[start + text].append({"item": item, "shared": shared})
    return out


def item_blocks(items: DataFrame, key: str, text: str, block: int = BLOCK) -> tuple[bool, Iterator[list]]:
    """Whether there are several blocks, and the rows of each: items of about ``block`` bytes of text, dealt out by hash."""
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block)
    return blocks > 1, ((rows.where(F.pmod(F.xxhash64("text", "key"), F.lit(blocks)) == b) if blocks > 1 else rows).collect() for b in range(blocks))


def hit_column(spark, texts: list[str], text: Column, n: int, least: tuple[int, int]) -> tuple[Column, Broadcast]:
    """The hits of each text, and the broadcast that finding them needs."""
    small_batches(spark)
    index = spark.sparkContext.broadcast(Items(texts, n))

    @F.pandas_udf("array<struct<item:int,shared:int>>")
    def search(series: pd.Series) -> pd.Series:
        return pd.Series(hits(pa.array(series, pa.string()), index.value, n, least), dtype=object)

    return search(text), index


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = WORDS, least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """key, item_key, n_item (shingles of the item), n_shared: a row for each document and item of which enough is in it."""
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = items.schema[item_key].dataType.simpleString()
    several, blocks = item_blocks(items, item_key, item_text, block)
    for some in blocks:
        sizes = [len(shingle_set(r.text, n)) for r in some]
        names = spark.createDataFrame([(i, r.key, s) for i, (r, s) in enumerate(zip(some, sizes, strict=True))], f"item int, item_key {kind}, n_item int")
        column, index = hit_column(spark, [r.text for r in some], F.col("text"), n, least)
        hit = rows.select("key", F.explode(column).alias("hit"))
        hit = hit.select("key", "hit.item", "hit.shared").join(F.broadcast(names), "item").select(F.col("key").alias(key), F.col("item_key").alias(item_key), "n_item", F.col("shared").alias("n_shared"))
        if several:
            hit = written(hit, "hits")
            index.destroy()
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return spark.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {kind}, n_item int, n_shared int")
    return found


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = WORDS, least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no item."""
    several, blocks = item_blocks(items, item_key, item_text, block)
    left = docs
    for some in blocks:
        column, index = hit_column(docs.sparkSession, [r.text for r in some], F.col(text), n, least)
        rest = left.where(F.size(column) == 0)
        if several:
            rest = written(rest, "clean")
            index.destroy()
            if left is not docs:
                forget(left)
        left = rest
    return left


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of whose five-word shingles at least 0.8 are in the document."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = f"""
WITH d AS ({shingle_sql("documents", "doc_id", WORDS)}), b AS ({shingle_sql("benchmark", "item_id", WORDS)}), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1)
SELECT d.doc_id, b.item_id, any_value(n_item)::INT AS n_item, count(*)::INT AS n_shared
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) * 5 >= any_value(n_item) * 4
"""
