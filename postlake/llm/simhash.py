"""SimHash near-dedup by pigeonhole blocks (operator 12).

A document's fingerprint has 64 bits: bit k is 1 if it is set in more than half of the XXH64 hashes of its word
shingles, repeats included. Fingerprints of which at most DISTANCE bits differ are linked, links make components.

1. One pass over the texts computes fingerprints; rows (id, fingerprint) are written. Equal fingerprints are one
   class from here on, so copies cost nothing, however many there are.
2. The bits are cut into BLOCKS runs. At most DISTANCE of them can hold a differing bit, so two close fingerprints
   agree in at least BLOCKS - DISTANCE of them: they share a bucket for at least one choice of so many runs.
3. A bucket of more than MOST fingerprints is dealt anew: the bits that it doesn't fix are cut in the same way, so a
   close pair shares one of its smaller buckets too. After three such cuts 14 bits are left, and no bucket can hold
   more than 16,384 fingerprints, at any size of the table.
4. Buckets are joined on their own members: rows are dealt by bucket, sorted, and each bucket's members are compared
   by XOR and popcount. Of the links that are found only a spanning forest is passed on, so output follows members,
   not pairs.
5. Links are joined to components as in operator 3, and each component takes its smallest id.

Every link is found: the blocks are a pigeonhole argument, not a sample, and a link that a forest leaves out joins
fingerprints which the forest joins already.

Defined results: null texts, empty ones and texts without words have fingerprint zero and are linked like any other;
texts with fewer words than a shingle have one shingle, their whole sequence; repeated rows are reported each; rows
with a null id have the component of their fingerprint (null if no row of it has an id); only key and text are read;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import LOWER, SPACE, UPPER, forget, small_batches, written
from postlake.llm.neardup import components

SEED, DISTANCE, BLOCKS, MOST = 42, 3, 5, 4096
#: Buckets that leave so many bits free aren't cut further: they hold 16,384 fingerprints at most.
LAST = 14
#: Shingles that are hashed and counted at once.
CHUNK = 1 << 17
#: Letters of A-Z lowered, all white space as spaces.
PLAIN = bytes.maketrans((UPPER + SPACE).encode(), (LOWER + " " * len(SPACE)).encode())


def shingle_hashes(text: str | None, n: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of n words of a text, in chunks. A shingle is a range of bytes of the text with single spaces."""
    data = np.frombuffer((text or "").encode().translate(PLAIN), np.uint8)
    word = data != 32
    kept = word.copy()
    kept[1:] |= word[:-1]  # the first space after a word
    data, word = data[kept], word[kept]
    if not len(data):
        return
    if not word[-1]:
        data, word = data[:-1], word[:-1]
    gaps = np.flatnonzero(~word)
    begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    if len(begins) < n:
        begins, ends = begins[:1], ends[-1:]
    else:
        begins, ends = begins[: len(begins) - n + 1], ends[n - 1 :]
    raw, hashed = data.tobytes(), xxhash.xxh64_intdigest
    for at in range(0, len(begins), CHUNK):
        some = zip(begins[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.fromiter((hashed(raw[a:b], SEED) for a, b in some), np.uint64)


def fingerprint(text: str | None, n: int) -> int:
    """The SimHash of a text, as a signed number."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, n):
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """key and fp (the fingerprint as a long) of each row."""
    small_batches(docs.sparkSession)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), n) for t in batch.column(1)], pa.int64())], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(printed, f"key {rows.schema[0].dataType.simpleString()}, fp long")


def masks(free: int, distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """For each choice of blocks - distance of the runs into which the free bits are cut, the bits of those runs. Two numbers that differ in at most ``distance`` of the free bits agree on one of them."""
    places = [i for i in range(64) if free >> i & 1]
    runs = [sum(1 << i for i in places[len(places) * b // blocks : len(places) * (b + 1) // blocks]) for b in range(blocks)]
    return [sum(some) for some in combinations(runs, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(classes: DataFrame, most: int = MOST) -> DataFrame:
    """(mask, bucket, fp): each fingerprint once for each bucket that it has. Those of buckets with more than ``most`` members are dealt to smaller ones, until there are none."""
    every, done = (1 << 64) - 1, None
    cuts = {0: masks(every)}  # by the bits that are fixed
    rows = classes.select("fp", F.lit(0).cast("long").alias("mask"))
    while cuts:
        finer = F.create_map(*(x for fixed, new in cuts.items() for x in (F.lit(signed(fixed)).cast("long"), F.array(*(F.lit(signed(fixed | m)).cast("long") for m in new)))))
        rows = rows.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
        rows = written(rows.distinct() if done is not None else rows, "buckets")
        large = (F.col("members") > most) & (F.bit_count("mask") < 64 - LAST)
        over = written(rows.groupBy("mask", "bucket").agg(F.count("*").alias("members")).where(large).select("mask", "bucket"), "over")
        cuts = {r.mask & every: masks(every & ~r.mask) for r in over.select("mask").distinct().collect()}  # there are at most as many as choices of runs
        small = rows.join(over, ["mask", "bucket"], "left_anti") if cuts else rows
        done = small if done is None else done.unionByName(small)
        rows = rows.join(over, ["mask", "bucket"]).select("fp", "mask")
    return done.select("mask", "bucket", "fp")


def forest(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links of each group join. fp: unsigned, each group's side by side."""
    root, found = np.arange(len(fp)), []
    left, d = np.arange(len(fp) - 1), 1
    while len(left):
        left = left[left + d < len(fp)]
        left = left[group[left] == group[left + d]]
        close = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= distance]
        close = close[root[close] != root[close + d]]
        if len(close):
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            for i, a, b in zip(close.tolist(), root[close].tolist(), root[close + d].tolist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    found.append((i, i + d))
            over = np.arange(len(fp))
            over[list(up)] = [top(x) for x in up]
            root = over[root]
        d += 1
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return fp[pairs[:, 0]], fp[pairs[:, 1]]


def links(dealt: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of fingerprints in buckets: links that join what all links join, each bucket in one place."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            same = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
            pairs = forest(rows[2].view(np.uint64), np.concatenate([[0], np.cumsum(~same)]), distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pairs], ["a", "b"])

        for batch in batches:
            held = np.concatenate([held, np.array([c.to_numpy() for c in batch.columns], np.int64).reshape(3, -1)], axis=1)
            if held.shape[1]:
                last = (held[0] == held[0, -1]) & (held[1] == held[1, -1])  # the last bucket may go on
                cut = int(np.argmax(last))
                if cut:
                    yield found(np.ascontiguousarray(held[:, :cut]))
                    held = held[:, cut:]
        if held.shape[1]:
            yield found(np.ascontiguousarray(held))

    return dealt.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp").mapInArrow(linked, "a long, b long")


def component_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """key, fp and component_id of each row."""
    if distance != DISTANCE:
        raise ValueError(f"blocks are cut for a distance of {DISTANCE}")
    rows = written(fingerprints(docs, key, text, n), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("key").alias("low")), "classes")
    near = written(links(buckets(classes, most), distance).distinct(), "links")
    comps = components(near)
    lows = comps.join(classes.withColumnRenamed("fp", "c"), "c").groupBy("comp").agg(F.min("low").alias("least"))
    ids = comps.join(lows, "comp").select(F.col("c").alias("fp"), "least")
    ids = classes.join(ids, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    out = written(rows.join(ids, "fp").select(F.col("key").alias(key), "fp", "component_id"), "rows")
    forget(rows, classes, near, comps)
    return out


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints of three-word shingles differ in three bits or fewer."""
    ids = component_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ids.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
