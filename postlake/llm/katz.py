"""Language-model scoring by Katz backoff (operator 8).

A bigram model: P(w | h) is the Good-Turing discounted share of w after h where the pair was seen, be it once,
else backoff(h) * P(w); P(w) is the discounted share of w, and what discounting leaves is the probability of the
one unknown word. Backoff weights are normalised exactly: for every history the probabilities of all known words
and the unknown one sum to 1.

The corpus is kept as blocks: tables of the distinct words (64-bit hashes) of about BLOCK tokens, and the tokens
as places in them. Blocks send their distinct words and pairs with counts, sorted and packed, to buckets of the
hash range; a bucket adds up what all blocks sent and stores the counts and weights as a row of the model's
tables. Blocks then read, in the order in which they sent, the values of their own words and pairs, and evaluate
each token from them, the pair first, then backoff and word. No pair or word has a row of its own in a shuffle,
a frequent word or pair weighs as much as any other. There are BUCKETS buckets for each of the session's shuffle
partitions, and more where a bucket would have more than BUCKET_TOKENS tokens' share of the corpus, so that its
memory doesn't follow the corpus. A text that is longer than a block goes on in the next one.

Defined results: a null or empty text is its end token alone; repeated rows are counted and scored each; null
keys are in the fold of empty text; without training rows all tokens are unknown with probability 1; only key
and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import forget, fresh_path, mixed, remainder, small_batches, written
from postlake.llm.shingles import parts, words

BLOCK, BUCKETS, BUCKET_TOKENS = 1 << 20, 4, 1 << 22
START, END = np.uint64(1), np.uint64(2)
DISCOUNTED = 5
PAIR = np.uint64(0x9E3779B97F4A7C15)


# ---- packing: sorted keys as differences, all numbers by byte planes, entropy-coded


def pack(x: np.ndarray, kind: str) -> bytes:
    x = np.ascontiguousarray(x, kind)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def pack_keys(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)), "<u8")


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, "<u8"), dtype=np.uint64)


def slices(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket's keys of so many bits begin among sorted ones (and the last end)."""
    edges = (np.arange(1, buckets, dtype=np.uint64)) * np.uint64(2**bits // buckets)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


# ---- blocks

BLOCKS = "block long, uids array<long>, keys array<{kind}>, held array<boolean>, at array<long>, before array<long>, words binary, tokens binary"


def blocked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (key, held, text). ``at`` says where each text's tokens begin, ``before`` the place of the word before the first."""
    task, count, uid = TaskContext.get().partitionId(), 0, 0
    pieces: list[tuple] = []  # uid, key, held, hashes, hash before
    held_tokens, key_type = 0, None

    def block() -> pa.RecordBatch:
        nonlocal count, held_tokens, pieces
        tokens = np.concatenate([p[3] for p in pieces])
        own, places = np.unique(np.concatenate([tokens, np.array([p[4] for p in pieces], np.uint64)]), return_inverse=True)
        at = np.concatenate([[0], np.cumsum([len(p[3]) for p in pieces])])
        row = [[(task << 24) + count], [[p[0] for p in pieces]], [[p[1] for p in pieces]], [[p[2] for p in pieces]], [at.tolist()], [places[len(tokens) :].tolist()], [pack_keys(own)], [pack(places[: len(tokens)], "<u4")]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(key_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        count, held_tokens, pieces = count + 1, 0, []
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["block", "uids", "keys", "held", "at", "before", "words", "tokens"])

    for batch in batches:
        key_type = batch.schema[0].type
        keys, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, stop in parts(batch.column(2)):
            hashes, at = words(batch.column(2).slice(start, stop - start))
            hashes[hashes <= END] += np.uint64(16)
            for i in range(stop - start):
                tokens = np.append(hashes[at[i] : at[i + 1]], END)
                before, row = START, (task << 40) + uid
                uid += 1
                while len(tokens):
                    take = min(len(tokens), size - held_tokens)
                    pieces.append((row, keys[start + i], held[start + i], tokens[:take], before))
                    held_tokens += take
                    before, tokens = tokens[take - 1], tokens[take:]
                    if held_tokens >= size:
                        yield block()
    if pieces:
        yield block()


class Block:
    """A block as read: its words, tokens, the word before each, and its distinct pairs in the order of their keys."""

    def __init__(self, words_raw: bytes, tokens_raw: bytes, at, before, held):
        self.words, self.tokens = unpack_keys(words_raw), unpack(tokens_raw, "<u4").astype(np.int64)
        self.at, self.before, self.held = np.asarray(at, np.int64), np.asarray(before, np.int64), np.asarray(held, bool)
        self.sizes = np.diff(self.at)
        self.train = np.repeat(~self.held, self.sizes)
        self.history = np.roll(self.tokens, 1)
        self.history[self.at[:-1]] = self.before

    def word_counts(self) -> np.ndarray:
        """Training counts of the block's words; that of START is how many texts start."""
        out = np.bincount(self.tokens[self.train], minlength=len(self.words))
        start = np.searchsorted(self.words, START)
        if start < len(self.words) and self.words[start] == START:
            out[start] = (~self.held & (self.before == start)).sum()
        return out

    def pairs(self, bits: int) -> None:
        codes, inverse = np.unique(self.history * len(self.words) + self.tokens, return_inverse=True)
        h, w = codes // len(self.words), codes % len(self.words)
        with np.errstate(over="ignore"):
            keys = mixed(mixed(self.words[h]) * PAIR + self.words[w]) >> np.uint64(64 - bits)
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair_keys, self.pair_h, self.pair_w, self.pair_of = keys[order], h[order], w[order], rank[inverse]

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.train], minlength=len(self.pair_keys))


def sent(batches: Iterator[pa.RecordBatch], buckets: int, pairs: bool, bits: int) -> Iterator[pa.RecordBatch]:
    """What each block sends to the buckets: its sorted words (or pairs) and their training counts."""
    for batch in batches:
        for row in batch.to_pylist():
            b = Block(row["words"], row["tokens"], row["at"], row["before"], row["held"])
            if pairs:
                b.pairs(bits)
            keys, counts = (b.pair_keys, b.pair_counts()) if pairs else (b.words, b.word_counts())
            cut = slices(keys, buckets, bits if pairs else 64)
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), row["block"])), pa.array([pack_keys(keys[cut[i] : cut[i + 1]]) for i in full], pa.binary()), pa.array([pack(counts[cut[i] : cut[i + 1]], "<u4") for i in full], pa.binary())], ["bucket", "block", "keys", "counts"])


SENT = "bucket int, block long, keys binary, counts binary"


def added(rows: pd.DataFrame, pairs: bool) -> pd.DataFrame:
    """A bucket's counts over all blocks, for each block in the order of what it sent, with the places of its words in the bucket's table, and (block -1) that table and how many keys have each small count. The first block that has a pair owns it."""
    rows = rows.sort_values("block")
    keys = [unpack_keys(k) for k in rows["keys"]]
    flat, counts = np.concatenate(keys), np.concatenate([unpack(c, "<u4") for c in rows["counts"]]).astype(np.int64)
    own, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    total = np.bincount(inverse, counts, len(own)).astype(np.int64)
    value = total[inverse]
    if pairs:
        value = value * 2
        value[first] += 1
    ends = np.cumsum([len(k) for k in keys])[:-1]
    words_only = total if pairs else total[own != START]
    stats = np.concatenate([np.bincount(np.minimum(words_only, DISCOUNTED + 2), minlength=DISCOUNTED + 3), [words_only.sum()]]).astype(np.int64)
    places = None if pairs else [pack_keys(p.astype(np.uint64)) for p in np.split(inverse, ends)]
    out = pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"], "keys": places, "values": [pack(v, "<u8") for v in np.split(value, ends)], "stats": None})
    return pd.concat([out, pd.DataFrame([{"bucket": rows["bucket"].iloc[0], "block": -1, "keys": pack_keys(own), "values": pack(total, "<u8"), "stats": stats.tolist()}])], ignore_index=True)


ADDED = "bucket int, block long, keys binary, values binary, stats array<long>"


# ---- the model


def discounts(n: np.ndarray) -> np.ndarray:
    """By count up to DISCOUNTED, the part of a count that stays: Katz's form of Good-Turing from how many keys have each count (n[r]). Where these numbers don't give parts between 0 and 1 in rising order, half a count is taken."""
    k = DISCOUNTED
    out = np.ones(k + 1)
    out[0] = 0
    with np.errstate(all="ignore"):
        r = np.arange(1, k + 1)
        common = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - common) / (1 - common)
    good = np.all(np.isfinite(d)) and np.all(d > 0) and np.all(d <= 1) and np.all(np.diff(d * r) > 0)
    out[1:] = d if good else (r - 0.5) / r
    return out


@dataclasses.dataclass
class Model:
    """The numbers that all parts of the model share."""

    total: int
    kinds: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, word_stats: np.ndarray, pair_stats: np.ndarray) -> Model:
        total, kinds = int(word_stats[-1]), int(word_stats[1:-1].sum())
        d1, d2 = discounts(word_stats[:-1].astype(float)), discounts(pair_stats[:-1].astype(float))
        left = float(sum(word_stats[r] * r * (1 - d1[r]) for r in range(1, DISCOUNTED + 1)))
        if not total:
            return cls(0, 0, d1, d2, 0.0, 1.0)
        if left >= 0.5:
            return cls(total, kinds, d1, d2, 1 / total, left / total)
        return cls(total, kinds, d1, d2, 1 / (total + 1), (left + 1) / (total + 1))  # no small counts: one token's worth is kept for the unknown

    @staticmethod
    def kept(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by count; 0 stands for the unknown word."""
        return np.where(counts > 0, self.kept(counts, self.word_discounts) * self.scale, self.unknown)

    def pair(self, counts: np.ndarray) -> np.ndarray:
        """What is kept of pair counts; 0 for unseen ones."""
        return np.where(counts > 0, self.kept(counts, self.pair_discounts), 0.0)


def answers(rows: pd.DataFrame, kind: str) -> pd.DataFrame:
    return rows[rows["kind"] == kind].sort_values("bucket")


def restored(block: pd.DataFrame, replies: pd.DataFrame, bits: int) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """A block with the counts of its words, those of its pairs, and which pairs it owns."""
    row = block.iloc[0]
    b = Block(row["words"], row["tokens"], row["at"], row["before"], row["held"])
    b.pairs(bits)
    counts = np.concatenate([unpack(v, "<u8") for v in answers(replies, "words")["values"]]).astype(np.int64)
    pairs = np.concatenate([unpack(v, "<u8") for v in answers(replies, "pairs")["values"]]).astype(np.int64)
    return b, counts, pairs >> 1, (pairs & 1).astype(bool)


def shares(block: pd.DataFrame, replies: pd.DataFrame, model: Model, buckets: int, bits: int) -> pd.DataFrame:
    """For each history of the pairs that a block owns: what is kept of the pairs' counts, and the sum of P(w)."""
    b, counts, pairs, owned = restored(block, replies, bits)
    use = owned & (pairs > 0)
    kept = np.bincount(b.pair_h[use], model.pair(pairs[use]), len(b.words))
    lower = np.bincount(b.pair_h[use], model.word(counts[b.pair_w[use]]), len(b.words))
    cut = slices(b.words, buckets)
    out = []
    for i in np.flatnonzero(np.diff(cut)):
        some = np.flatnonzero(kept[cut[i] : cut[i + 1]]) + cut[i]
        if len(some):
            out.append((i, block["block"].iloc[0], pack_keys(b.words[some]), pack(kept[some], "<f8"), pack(lower[some], "<f8")))
    return pd.DataFrame(out, columns=["bucket", "block", "keys", "kept", "lower"])


def weighted(counts: pd.DataFrame, parts_of: pd.DataFrame, model: Model) -> pd.DataFrame:
    """A bucket's backoff weights and denominators, for each block in the order of its words, and (block -1) for the table."""
    table = counts[counts["block"] < 0].iloc[0]
    keys, total = unpack_keys(table["keys"]), unpack(table["values"], "<u8").astype(np.int64)
    kept, lower = np.zeros(len(keys)), np.zeros(len(keys))
    for row in parts_of.sort_values("block").itertuples():
        at = np.searchsorted(keys, unpack_keys(row.keys))
        kept[at] += unpack(row.kept, "<f8")
        lower[at] += unpack(row.lower, "<f8")
    below = np.maximum(total, 1) + np.where(total - kept < 0.5, 1, 0)  # where nothing was discounted, one token's worth is kept for what wasn't seen
    backoff = np.where(total > 0, (1 - kept / below) / np.maximum(1 - lower, 1e-300), 1.0)
    out = [(table["bucket"], -1, pack(backoff, "<f8"), pack(below, "<u8"))]
    for row in counts[counts["block"] >= 0].itertuples():
        at = unpack_keys(row.keys).astype(np.int64)
        out.append((row.bucket, row.block, pack(backoff[at], "<f8"), pack(below[at], "<u8")))
    return pd.DataFrame(out, columns=["bucket", "block", "values", "below"])


def scored(block: pd.DataFrame, replies: pd.DataFrame, model: Model, bits: int) -> pd.DataFrame:
    """Sums over the tokens of each text of a block."""
    b, counts, pairs, _ = restored(block, replies, bits)
    weights = answers(replies, "weights")
    backoff = np.concatenate([unpack(v, "<f8") for v in weights["values"]])
    below = np.concatenate([unpack(v, "<u8") for v in weights["below"]]).astype(np.int64)
    kept = model.pair(pairs)
    with np.errstate(divide="ignore"):
        of_pair = np.where(kept > 0, np.log10(kept / below[b.pair_h]), np.log10(backoff[b.pair_h]) + np.log10(model.word(counts[b.pair_w])))
    base = np.log10((counts + 1) / (model.total + model.kinds + 1))
    row, at = block.iloc[0], b.at[:-1]
    return pd.DataFrame({"uid": row["uids"], "key": pd.Series(list(row["keys"]), dtype=object), "held_out": b.held, "n_tokens": b.sizes, "n_known": np.add.reduceat((counts > 0)[b.tokens].astype(np.int64), at), "base_score": np.add.reduceat(base[b.tokens], at), "score": np.add.reduceat(of_pair[b.pair_of], at)})


def stats_of(table: DataFrame) -> np.ndarray:
    """The sums of the buckets' statistics: a few numbers."""
    width = DISCOUNTED + 4
    row = table.where("block = -1").agg(*(F.sum(F.col("stats")[i]) for i in range(width))).first()
    return np.array([x or 0 for x in row], np.int64)


def corpus(docs: DataFrame, held: Column, key: str, text: str, size: int) -> tuple[DataFrame, Callable[[], None]]:
    rows = docs.select(F.col(key).alias("key"), held.alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return bucketed(rows.mapInArrow(lambda b: blocked(b, size), BLOCKS.format(kind=kind)), "block", "blocks")


def bucketed(df: DataFrame, column: str, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared folder, bucketed by a column, so that grouping by it moves no row of it again; and what drops the table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).saveAsTable(table)
    out = spark.table(table)

    def drop() -> None:
        forget(out)
        spark.sql(f"DROP TABLE IF EXISTS {table}")

    return out, drop


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; the model learns from rows for which ``held`` (a column of docs) is false."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks, drop = corpus(docs, held, key, text, block)
    kind = docs.schema[key].dataType.simpleString()
    # pairs are hashed to so many bits that few of them, if any, can share a key: their number squared is below 2 ** (bits + 2)
    tokens = blocks.agg(F.sum(F.element_at("at", -1))).first()[0] or 1
    buckets = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET_TOKENS)
    bits = min(64, max(40, 2 * int(tokens).bit_length() - 2))

    def counts_of(pairs: bool, name: str) -> DataFrame:
        parts_of = blocks.select("block", "words", "tokens", "at", "before", "held").mapInArrow(lambda b: sent(b, buckets, pairs, bits), SENT)
        return written(parts_of.groupBy("bucket").applyInPandas(lambda rows: added(rows, pairs), ADDED), name)

    counted = [counts_of(False, "word-counts"), counts_of(True, "pair-counts")]
    model = Model.of(*map(stats_of, counted))

    replies = [t.where("block >= 0").select("block", F.lit(name).alias("kind"), "bucket", "values", F.lit(None).cast("binary").alias("below")) for t, name in zip(counted, ("words", "pairs"), strict=True)]
    by_block = lambda x: x.groupBy("block")
    shared = by_block(blocks).cogroup(by_block(replies[0].unionByName(replies[1]))).applyInPandas(lambda b, r: shares(b, r, model, buckets, bits), "bucket int, block long, keys binary, kept binary, lower binary")
    weights = written(counted[0].groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInPandas(lambda c, s: weighted(c, s, model), "bucket int, block long, values binary, below binary"), "weights")
    replies.append(weights.where("block >= 0").select("block", F.lit("weights").alias("kind"), "bucket", "values", "below"))
    pieces = by_block(blocks).cogroup(by_block(replies[0].unionByName(replies[1]).unionByName(replies[2]))).applyInPandas(lambda b, r: scored(b, r, model, bits), f"uid long, key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = pieces.groupBy("uid", "key", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    whole = written(whole.drop("uid"), "scores")
    drop()
    forget(*counted, weights)
    return whole.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_katz_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 modulo 7 isn't 2."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder(F.col("doc_id"), 7) == 2)
