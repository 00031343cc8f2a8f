"""Byte-level BPE encoding and decoding (operator 1).

Texts up to ``chunk`` characters are encoded where they are. A longer text is cut into chunks that overlap.
Each chunk is pre-tokenised on its own, in parallel; two neighbours are stitched at the first pre-token
boundary that both find in their overlap, because from a common boundary on both scans are the same. The
pieces between such cuts start and end at true boundaries, so they are encoded independently and their ids
joined in order. Decoding joins the raw bytes of the ids.

Defined results: a null text counts as empty and has no ids; empty text has no ids; repeated rows give
repeated rows; a null id stays null; only the key and the text are read, so further columns can have any
name; an empty table gives an empty table. Ids are kept as little-endian unsigned 32-bit integers in a
binary column (unpack() makes an array of them).
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import small_batches

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 32768, 512
#: A match is settled if two more characters follow it: the longest look ahead is that of 're, 've and 'll.
AHEAD = 2
#: Runs of one kind of character longer than this are encoded by merge() instead of the library, whose pattern engine has a limited stack.
LONG_RUN = 100_000


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def pattern() -> regex.Pattern:
    """The library's pattern with its meaning of white space spelt out, which this engine's shorthand doesn't share."""
    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@functools.cache
def is_space(character: str) -> bool:
    return regex.match(r"\p{White_Space}", character) is not None


def divides(text: str, at: int) -> bool:
    """Whether text may be cut at a boundary without changing how its parts are split: not where white space ends, since its last character stands alone only if something follows."""
    return at >= len(text) or not is_space(text[at - 1]) or is_space(text[at])


@functools.cache
def table(path: str) -> list[bytes]:
    by_id = [b""] * (max(ranks(path).values()) + 1)
    for token, rank in ranks(path).items():
        by_id[rank] = token
    return by_id


def encode_piece(text: str, path: str) -> bytes:
    """The ids of a text that starts and ends at pre-token boundaries."""
    if len(text) <= LONG_RUN:
        return encoding(path).encode_to_numpy(text).astype("<u4", copy=False).tobytes()
    out, start, end = [], 0, 0
    for match in pattern().finditer(text):  # parts of bounded length, cut between matches
        if match.end() - start > LONG_RUN and end > start and divides(text, end):
            out.append(encoding(path).encode_to_numpy(text[start:end]).astype("<u4", copy=False).tobytes())
            start = end
        end = match.end()
        if end - start > LONG_RUN and match.start() == start:
            out.append(np.array(encoding(path)._encode_single_piece(text[start:end]), "<u4").tobytes())
            start = end
    out.append(encoding(path).encode_to_numpy(text[start:]).astype("<u4", copy=False).tobytes())
    return b"".join(out)


def decode_ids(ids: bytes, path: str) -> bytes:
    return b"".join(map(table(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def encoded(batches: Iterator[pa.RecordBatch], path: str, decoding: bool) -> Iterator[pa.RecordBatch]:
    """The batches with their last column, a text, replaced by its ids and, if asked for, what these decode to."""
    for batch in batches:
        ids = [encode_piece(x.as_py(), path) for x in batch.column(batch.num_columns - 1)]
        out = [pa.array(ids, pa.binary())] + ([pa.array([decode_ids(x, path) for x in ids], pa.binary())] if decoding else [])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "ids", "decoded"][: batch.num_columns + decoding])


def decoded(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x.as_py() is None else decode_ids(x.as_py(), path) for x in batch.column(at)], pa.binary())], [*batch.schema.names, "decoded"])


def chunk_bounds(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of a text: each but the last reaches ``overlap`` characters into the next."""
    return [(a, min(length, a + chunk + overlap)) for a in range(0, length, chunk)]


def boundaries(text: str, start: int, last: bool) -> list[int]:
    """Settled ends of pre-tokens of a chunk that begins at ``start`` of its document, and start itself, where the text may be cut."""
    ends = (m.end() for m in pattern().finditer(text))
    return [start, *(start + e for e in ends if (last or e + AHEAD <= len(text)) and divides(text, e))]


def scanned(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of each document, each pre-tokenised by itself once dealt out (see scan)."""
    for batch in batches:
        for key, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
            cuts = chunk_bounds(len(text), chunk, overlap)
            for first in range(0, len(cuts), 64):
                part = list(enumerate(cuts))[first : first + 64]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array([c for c, _ in part], pa.int64()), pa.array([a for _, (a, _) in part], pa.int64()), pa.array([c == len(cuts) - 1 for c, _ in part]), pa.array([text[a:b] for _, (a, b) in part])], ["k", "c", "start", "last", "body"])


def scan(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the boundaries it finds in the overlap before it and in the one after it, and those of the latter that hold whatever stands before (a space after something else)."""
    for batch in batches:
        left, right, sure = [], [], []
        for start, last, body in zip(*(batch.column(c).to_pylist() for c in ("start", "last", "body")), strict=True):
            found = boundaries(body, start, last)
            left.append([b for b in found if b <= start + overlap])
            right.append([] if last else [b for b in found if b >= start + chunk])
            sure.append([] if last else [start + p for p in range(max(1, chunk), len(body)) if is_space(body[p]) and not is_space(body[p - 1])])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (left, right, sure)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("c"), *lists], ["k", "c", "left", "right", "sure"])


def stitched(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chunks of one document are cut. A chunk whose scan doesn't meet the one before it goes to the same piece; only sure boundaries count until one is found."""
    rows = rows.sort_values("c").drop_duplicates("c")
    piece, begin, true, out = 0, 0, True, []
    lefts, rights, sures = (rows[x].tolist() for x in ("left", "right", "sure"))
    for i, c in enumerate(rows["c"].tolist()):
        cut = None
        if i + 1 < len(rows):
            own, follows = set(map(int, rights[i])), set(map(int, lefts[i + 1]))
            common = own & follows if true else set(map(int, sures[i]))
            cut = min((x for x in common if x > begin), default=None)
        out.append((c, piece, begin, -1 if cut is None else cut))
        if cut is not None:
            piece, begin, true = piece + 1, cut, True
        elif i + 1 < len(rows):
            begin, true = -1, False
    return pd.DataFrame({"k": rows["k"].iloc[0], "c": [x[0] for x in out], "piece": [x[1] for x in out], "begin": [x[2] for x in out], "cut": [x[3] for x in out]})


def joined(rows: pd.DataFrame, path: str, decoding: bool) -> pd.DataFrame:
    """The ids of a document's pieces in order, and their bytes if asked for."""
    ids = b"".join(rows.sort_values("piece")["ids"])
    return pd.DataFrame({"k": [rows["k"].iloc[0]], "ids": [ids]} | ({"decoded": [decode_ids(ids, path)]} if decoding else {}))


def encode_long(texts: DataFrame, path: str, chunk: int, overlap: int, decoding: bool) -> DataFrame:
    """(k, text) with distinct k to (k, ids) and decoded, if asked for, each text by overlapping chunks."""
    chunks = texts.mapInArrow(lambda b: scanned(b, chunk, overlap), "k string, c long, start long, last boolean, body string").repartition("k", "c")
    cuts = chunks.mapInArrow(lambda b: scan(b, chunk, overlap), "k string, c long, left array<long>, right array<long>, sure array<long>").groupBy("k").applyInPandas(stitched, "k string, c long, piece long, begin long, cut long")
    # a chunk gives its piece the text from the cut behind it to the cut before it; where a piece spans chunks, each gives what the next doesn't
    size = F.char_length("body")
    begin = F.when(F.col("begin") >= 0, F.col("begin") - F.col("start")).otherwise(F.lit(0))
    end = F.when(F.col("cut") >= 0, F.col("cut") - F.col("start")).when(F.col("last"), size).otherwise(F.lit(chunk))
    parts = chunks.join(cuts, ["k", "c"]).select("k", "piece", "c", begin.alias("a"), end.alias("b"), "body")
    parts = parts.select("k", "piece", F.struct("c", F.substring("body", (F.col("a") + 1).cast("int"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).cast("int")).alias("part")).alias("part"))
    pieces = parts.groupBy("k", "piece").agg(F.array_join(F.sort_array(F.collect_list("part"))["part"], "").alias("text"))
    ids = pieces.mapInArrow(lambda b: encoded(b, path, False), "k string, piece long, ids binary")
    return ids.groupBy("k").applyInPandas(lambda rows: joined(rows, path, decoding), "k string, ids binary" + ", decoded binary" * decoding)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, decoding: bool = False) -> DataFrame:
    """key, ids (packed, see unpack()) and n_tokens of each row of docs; with decoding also decoded, the bytes that the ids stand for, in the same pass."""
    if overlap > chunk:
        raise ValueError("an overlap can't be longer than a chunk")
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fits: Column = F.char_length("text") <= chunk
    more = ["decoded"] * decoding
    short = rows.where(fits).mapInArrow(lambda b: encoded(b, path, decoding), f"key {rows.schema[0].dataType.simpleString()}, ids binary" + ", decoded binary" * decoding)
    long = rows.where(~fits).withColumn("k", F.sha2(F.col("text"), 256))
    ids = encode_long(long.select("k", "text").dropDuplicates(["k"]), path, chunk, overlap, decoding)
    both = short.unionByName(long.select("key", "k").join(ids, "k").select("key", "ids", *more))
    return both.select(F.col("key").alias(key), "ids", F.expr("octet_length(ids) div 4").alias("n_tokens"), *more)


def decode(encoded_rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """encoded_rows with a column of the raw bytes of their ids, named decoded (in place of one that they have)."""
    path, rows = path or public_tokenizers.path(RANKS), encoded_rows.drop("decoded")
    at = rows.columns.index(ids)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda b: decoded(b, path, at), f"{kinds}, decoded binary")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoding=True))


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
