"""Toxicity by subword-bag embeddings (operator 2).

A word is the bag of its character n-grams (3 to 6, with marks at its ends) and of itself, each hashed to a
row of an embedding table. The rows of the words of a window are averaged and go into a linear softmax of two
classes; a text's score is that of its most toxic window, so that a few words count as much in a long text as
in a short one. Embeddings and softmax are trained jointly in numpy, on texts with one label each: each pass
takes every text's highest window and follows the gradient of the log loss there (AdaGrad). They start from
the n-grams' smoothed log odds of occurring in toxic texts. A misspelling that training has not seen shares
most of its n-grams with the word it stands for.

Training is on a bounded sample of labelled rows with whole texts: in the order of hashed ids, SAMPLE rows at most,
of which those are taken that keep the sample within CHARACTERS characters. Scoring covers every text whole; what
goes to the tasks is the model, whose size is fixed (one number for each hashed n-gram: the linear softmax of an
embedding).

Defined results: null and empty texts, and texts without words, get the score of the softmax for an empty
window; repeated rows are scored each; rows with null ids are scored; of several labels of an id the highest
counts, and null labels count as none; without labels of both classes every score is the share of toxic ones
(a quarter if there are none, so that nothing is rejected unlearnt); only ids, texts and labels are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import forget, mixed, remainder, small_batches, written

SAMPLE, CHARACTERS = 4000, 32_000_000
BUCKETS, DIMENSIONS, GRAMS, WIDTH = 1 << 18, 8, (3, 4, 5, 6), 3
ROUNDS, RATE, SMOOTH, DECAY = 60, 0.3, 3.0, 1e-4
FOLDS = 5
KEPT = 300_000
WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word's n-grams and of the word itself, and where each word's begin."""
    marked = "".join(f"<{w}>" for w in words)
    data = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = begins[owner + 1] if len(words) else begins[:0]
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
        whole = mixed(np.add.reduceat(mixed(data) * power[np.arange(len(data)) - begins[owner]], begins[:-1])) if len(words) else data
        owners, rows = [np.arange(len(words))], [whole]
        rolled = np.zeros(len(data), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            rolled = rolled[: len(data) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + data[n - 1 :] if n <= len(data) else data[:0]
            if n in GRAMS:
                inside = np.arange(len(rolled)) + n <= ends[: len(rolled)]
                owners.append(owner[: len(rolled)][inside])
                rows.append(mixed(rolled[inside] + np.uint64(n)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return (np.concatenate(rows)[order] % np.uint64(BUCKETS)).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(owners), minlength=len(words)))])


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """What scoring needs of the trained model: the difference of the two classes' softmax inputs for each row of the table, and the difference of their biases."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights.astype(np.float32), float(bias), {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def word_values(self, words: list[str]) -> None:
        if len(self.known) > KEPT:
            self.known.clear()
        new = list({w for w in words if w not in self.known})
        for first in range(0, len(new), 20_000):
            some = new[first : first + 20_000]
            rows, begins = subwords(some)
            self.known.update(zip(some, (np.add.reduceat(self.weights[rows], begins[:-1]) / np.diff(begins)).tolist(), strict=True))

    def scores(self, texts) -> np.ndarray:
        lists = [tokens(t) for t in texts]
        out = np.full(len(lists), self.bias)
        for i, words in enumerate(lists):
            if words:
                self.word_values(words)
                out[i] += windows(np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))).max()
        return logistic(out)


def windows(values: np.ndarray) -> np.ndarray:
    """Means over windows of WIDTH values, or over all if there are fewer."""
    if len(values) <= WIDTH:
        return values.mean(keepdims=True)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[WIDTH:] - sums[:-WIDTH]) / WIDTH


def fit(texts: list[str], labels: list[int]) -> Model:
    """Trains embeddings and softmax on labelled texts."""
    y, names = np.array(labels, np.float64), {}
    # of each text the numbers of its words only, so that the driver never holds all words as strings
    ids = [np.fromiter((names.setdefault(w, len(names)) for w in tokens(t)), np.int32) for t in texts]
    used = np.array([len(x) > 0 for x in ids], bool)
    y, ids = y[used], [x for x in ids if len(x)]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.25) / (len(y) + 1)
        return Model(np.zeros(BUCKETS), math.log(share / (1 - share)))
    words = list(names)
    some = [subwords(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
    rows, sizes = np.concatenate([r for r, _ in some]), np.concatenate([np.diff(b) for _, b in some])
    begins = np.concatenate([[0], np.cumsum(sizes)])

    # log odds by number of texts that have a row
    in_texts = np.zeros((2, BUCKETS))
    for own, label in zip(ids, y, strict=True):
        distinct = np.unique(own)
        at = np.repeat(begins[distinct], sizes[distinct]) + np.arange(sizes[distinct].sum()) - np.repeat(np.cumsum(sizes[distinct]) - sizes[distinct], sizes[distinct])
        in_texts[int(label), np.unique(rows[at])] += 1
    share = (in_texts + SMOOTH * (np.bincount(y.astype(int), minlength=2) / len(y))[:, None]) / (np.bincount(y.astype(int), minlength=2)[:, None] + SMOOTH)
    odds = np.log(share[1] / share[0])

    rng = np.random.default_rng(1)
    embed = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)).astype(np.float32)
    embed[:, 0] += odds
    soft = np.zeros((DIMENSIONS, 2))
    soft[0] = (-1.0, 1.0)
    bias = np.array([0.0, -4.0])

    flat = np.concatenate(ids)
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(at))
    width = np.minimum(np.diff(at), WIDTH)
    fits = np.arange(len(flat)) + width[owner] <= at[owner + 1]
    first = np.flatnonzero(fits)
    owner_of, width_of = owner[first], width[owner[first]].astype(np.int32)
    texts_at = np.searchsorted(owner_of, np.arange(len(ids)))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    squares = [np.full_like(embed, 1e-6), np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)]
    for _ in range(ROUNDS):
        line = embed @ soft.astype(np.float32)
        value = np.add.reduceat((line[:, 1] - line[:, 0])[rows], begins[:-1]) / sizes
        sums = np.concatenate([[0.0], np.cumsum(value[flat])])
        mean = (sums[first + width_of] - sums[first]) / width_of
        best = np.maximum.reduceat(mean, texts_at)
        # the first window of each text that reaches its best
        top = np.flatnonzero(mean == best[owner_of])
        top = first[top[np.unique(owner_of[top], return_index=True)[1]]]
        error = (logistic(best + bias[1] - bias[0]) - y) * weight / len(y)

        place = np.repeat(top, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        words_in = flat[place]
        share_of = np.repeat(error / width, width) / sizes[words_in]
        gram_at = np.repeat(begins[words_in], sizes[words_in]) + np.arange(sizes[words_in].sum()) - np.repeat(np.cumsum(sizes[words_in]) - sizes[words_in], sizes[words_in])
        pull = np.bincount(rows[gram_at], np.repeat(share_of, sizes[words_in]), BUCKETS)  # of the difference of the classes, by row
        touched = np.flatnonzero(pull)
        grad_embed = pull[touched, None] * (soft[:, 1] - soft[:, 0])[None, :] + DECAY / len(y) * embed[touched]
        diff = embed[touched].T @ pull[touched]
        grad_soft = np.stack([-diff, diff], 1)
        grad_bias = np.array([-error.sum(), error.sum()])
        squares[0][touched] += grad_embed**2
        embed[touched] -= RATE * grad_embed / np.sqrt(squares[0][touched])
        for value_of, grad, square in ((soft, grad_soft, squares[1]), (bias, grad_bias, squares[2])):
            square += grad**2
            value_of -= RATE * 0.2 * grad / np.sqrt(square)
    line = embed @ soft
    return Model(line[:, 1] - line[:, 0], bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, sample: int = SAMPLE, characters: int = CHARACTERS) -> Model:
    """A model of the labels whose key's crc32 modulo folds isn't 0, from ``sample`` of them and texts of ``characters`` in all at most."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.max("label").alias("label"))
    chosen = known.where(remainder(F.col("key"), folds) != 0).orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = written(texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label")), "sample")
    left, keys = characters, []
    for row in found.select("key", F.char_length("text").alias("size"), F.xxhash64("key").alias("h")).orderBy("h", "key").collect():  # of ``sample`` rows at most
        if row.size <= left:
            left -= row.size
            keys.append(row.key)
    rows = found.where(F.col("key").isin(keys)).collect() if len(keys) < found.count() else found.collect()
    forget(found)
    rows.sort(key=lambda r: r.key)
    return fit([r.text for r in rows], [int(r.label > 0) for r in rows])


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of each text, by a model that is sent to each executor once."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts))

    return scored(text)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every whole text of documents; labels of the held-out fold are not learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", score(spark, model, F.col("text")).alias("score"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
