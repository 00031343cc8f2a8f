"""Token ids in sorted-string-table shards (operator 4).

Documents are dealt out by ranges of their key, sorted, encoded and written in one pass: each task writes one
shard to a temporary name in the output folder and renames it when it is whole, so a lost or repeated attempt
leaves nothing behind that is read. A shard is

    block*            entries in key order, about BLOCK bytes each
    sparse index      of each block: first key, offset, length, entries, ids before it in the shard
    Bloom filter      of the shard's keys
    footer            fixed size: offsets and lengths of the two, counts, width of an id, magic

An entry is the length of the prefix that its key shares with the one before it, the rest of the key, the
number of ids and the ids (little-endian, two or four bytes). lookup() picks shards by key range, asks the
Bloom filter, finds the block by binary search in the index and reads that block only.

What passes through the driver is one manifest row for each shard.

Defined results: a null text counts as empty and has the end id only; a null key comes before all others;
rows that repeat a key follow each other in the order of their texts' hashes; only key and text are read; an
empty table gives no rows. A key that many rows share is spread over shards by those hashes and row numbers.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import fresh_path, mixed, small_batches

VOCABULARY, END = "word_bpe_49k.json", 2
BLOCK = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<6QI8s")
MAGIC = b"PLSST001"
INDEX = struct.Struct("<9s4Q")
#: The pre-tokeniser drops white space and lets no token cross it, nor the place between a letter or digit and such a mark, so words between white space are kept with their ids, and a new one is put together from parts that are encoded once. Only ASCII letters and digits and the letters of Latin-1 (two bytes of UTF-8) count here: composing and lowering leave them letters, while others may end in a combining mark, which joins the marks that follow. The apostrophe is no such mark.
PART = re.compile(rb"(?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?=[!-&(-/:-@\[-`{-~])|[^ \t\n\r\x0b\x0c]+")
#: Texts with a letter from U+0300 on (combining marks, with which a small letter may compose where its capital doesn't) or what may begin a special token aren't lowered before the tokenizer does.
AS_IS = re.compile(rb"[\xcc-\xff]|<\|")
KEPT = 600_000
#: Parts that are encoded as one text.
JOINED = 200


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs side by side
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def kept_parts(path: str) -> dict[bytes, bytes]:
    return {}


@functools.cache
def divider(path: str) -> tuple[int, str] | None:
    """A token that the tokenizer takes out of a text before anything else and that leaves what stands beside it alone, so parts joined by it are encoded as if each stood alone."""
    for i, token in tokenizer(path).get_added_tokens_decoder().items():
        if token.special and token.content.startswith("<|") and not (token.normalized or token.lstrip or token.rstrip or token.single_word):
            return i, token.content
    return None


def encode_parts(parts: list[bytes], path: str) -> Iterator[tuple[bytes, bytes]]:
    """Each part and its ids. Parts are joined to texts of JOINED, whose ids are cut at the divider; those that may hold one are encoded alone."""
    by, alone = divider(path), parts
    if by:
        alone, joined = [], []
        for p in parts:
            (alone if b"<|" in p else joined).append(p)
        texts = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        mark = by[1].encode()
        for own, found in zip(texts, tokenizer(path).encode_batch_fast([mark.join(x).decode() for x in texts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = [*(4 * np.flatnonzero(ids == by[0])).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            yield from zip(own, [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)], strict=True)
    for part, found in zip(alone, tokenizer(path).encode_batch_fast([p.decode() for p in alone], add_special_tokens=False), strict=True):
        ids = found.ids
        yield part, struct.pack(f"<{len(ids)}I", *ids)


def encode_texts(texts: list[str], path: str, end: int = END) -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit integers."""
    known, tail = kept_parts(path), np.array([end], "<u4").tobytes()
    if len(known) > KEPT:
        known.clear()
    words = [(t if AS_IS.search(t) else t.lower()).split() for t in map(str.encode, texts)]  # at ASCII white space, and of ASCII letters only
    new = list(set().union(*words).difference(known))
    for first in range(0, len(new), 10_000):
        some = [(w, (w,) if w.isalnum() else PART.findall(w)) for w in new[first : first + 10_000]]
        parts = list({p for _, own in some for p in own}.difference(known))
        known.update(encode_parts(parts, path))
        for word, own in some:
            if len(own) > 1:
                known[word] = b"".join([known[p] for p in own])
    return [b"".join([*map(known.__getitem__, x), tail]) for x in words]


def key_bytes(key: int | None) -> bytes:
    """Nine bytes in the order of the keys, null first."""
    return b"\0" * 9 if key is None else b"\1" + (key + (1 << 63)).to_bytes(8, "big")


def key_of(raw: bytes) -> int | None:
    return int.from_bytes(raw[1:], "big") - (1 << 63) if raw[0] else None


def bloom_places(raw: np.ndarray, bits: int) -> np.ndarray:
    """For each key (as 64-bit number) its places in a filter of so many bits."""
    a = mixed(raw)
    b = mixed(a) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Writer:
    """Writes one shard; keys must come in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at, self.docs, self.ids = out, width, 0, 0, 0
        self.block, self.first, self.entries, self.before, self.last = bytearray(), b"", 0, 0, b""
        self.index: list[bytes] = []
        self.keys: list[int] = []
        self.range = [None, None]

    def add(self, key: int | None, ids: bytes) -> None:
        raw, n = key_bytes(key), len(ids) // 4
        if len(self.block) >= BLOCK:
            self.flush()
        shared = 0
        if self.block:
            while shared < 9 and raw[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = raw, self.ids
        self.block += struct.pack("<BI", shared, n) + raw[shared:] + (ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        if not self.docs:
            self.range[0] = raw
        self.range[1] = self.last = raw
        self.keys.append(int.from_bytes(raw[1:], "big") ^ raw[0])
        self.entries, self.docs, self.ids = self.entries + 1, self.docs + 1, self.ids + n

    def flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append(INDEX.pack(self.first, self.at, len(self.block), self.entries, self.before))
            self.at += len(self.block)
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 64) * 64)
        bloom = np.zeros(bits, bool)
        for first in range(0, len(self.keys), 100_000):
            bloom[bloom_places(np.array(self.keys[first : first + 100_000], np.uint64), bits)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.docs, self.ids, self.width, MAGIC))


def opened(uri: str):
    """The file system of a URI and the path on it."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


class Shard:
    """A shard that is open for reading."""

    def __init__(self, uri: str):
        files, path = opened(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        index_at, index_size, self.bloom_at, self.bloom_size, self.docs, self.ids, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a shard")
        self.index = list(INDEX.iter_unpack(self.file.read_at(index_size, index_at)))

    def may_hold(self, key: int | None) -> bool:
        raw = key_bytes(key)
        bloom = np.frombuffer(self.file.read_at(self.bloom_size, self.bloom_at), np.uint8)
        places = bloom_places(np.array([int.from_bytes(raw[1:], "big") ^ raw[0]], np.uint64), self.bloom_size * 8)[0]
        return bool(np.all(bloom[places >> np.uint64(3)] >> (7 - (places & np.uint64(7))).astype(np.uint8) & 1))

    def entries(self, block: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids before it in the shard, ids) of a block's entries."""
        _, at, size, count, before = self.index[block]
        data, p, key = self.file.read_at(size, at), 0, b""
        for _ in range(count):
            shared, n = struct.unpack_from("<BI", data, p)
            p += 5
            key = key[:shared] + data[p : p + 9 - shared]
            p += 9 - shared
            raw = data[p : p + n * self.width]
            p += n * self.width
            yield key, before, raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
            before += n

    def find(self, key: int | None) -> list[bytes]:
        """Ids of each row with this key."""
        raw = key_bytes(key)
        if not self.may_hold(key):
            return []
        block, found = max(0, bisect.bisect_left([i[0] for i in self.index], raw) - 1), []
        while block < len(self.index) and self.index[block][0] <= raw:
            found += [ids for k, _, ids in self.entries(block) if k == raw]
            block += 1
        return found


MANIFEST = "shard int, path string, first binary, last binary, docs long, ids long"


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, shards: int | None = None) -> list:
    """Writes docs as shards (as many as shuffles have partitions, at most, unless shards says) in a folder that all executors reach; the manifest: a row for each shard, in key order."""
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)
    width = 2 if max(tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, into = opened(folder)
        files.create_dir(into, recursive=True)
        task = TaskContext.get()
        final, partial = f"shard-{task.partitionId():05d}.sst", f"{into}/partial-{task.partitionId()}-{task.taskAttemptId()}"
        with files.open_output_stream(partial) as out:
            writer = Writer(out, width)
            for batch in batches:
                for k, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), path, end), strict=True):
                    writer.add(k, ids)
            writer.close()
        if not writer.docs:
            files.delete_file(partial)
            return
        try:
            files.move(partial, f"{into}/{final}")
        except OSError:  # a store that doesn't replace files, and an attempt before this one that got so far
            files.delete_file(f"{into}/{final}")
            files.move(partial, f"{into}/{final}")
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": f"{folder}/{final}", "first": writer.range[0], "last": writer.range[1], "docs": writer.docs, "ids": writer.ids}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("docs", pa.int64()), ("ids", pa.int64())]))

    dealt = rows.repartitionByRange(*([shards] if shards else []), "key", "h", "n").sortWithinPartitions("key", "h", "n").select("key", "text")
    return sorted(dealt.mapInArrow(shard, MANIFEST).collect(), key=lambda r: r.shard)


def read(spark: SparkSession, manifest: list) -> DataFrame:
    """key, start, n_tokens and ids of every row, from the files of a manifest; a task for each shard."""
    starts, total = [], 0
    for m in manifest:
        starts.append((m.path, total))
        total += m.ids

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                for block in range(len(shard.index)):
                    keys, before, ids = zip(*shard.entries(block), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(map(key_of, keys), pa.int64()), pa.array([start + b for b in before], pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "start", "n_tokens", "ids"])

    shards = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    return shards.mapInArrow(entries, "key long, start long, n_tokens long, ids binary")


def lookup(manifest: list, key: int | None) -> list[list[int]]:
    """The ids of each row with this key, by binary search."""
    raw, found = key_bytes(key), []
    for m in manifest[bisect.bisect_left([bytes(m.last) for m in manifest], raw) :]:
        if bytes(m.first) > raw:
            break
        found += [np.frombuffer(ids, "<u4").tolist() for ids in Shard(m.path).find(key)]
    return found


def op4_sstable_ids(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, written as shards in the shared folder and read back from them."""
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "sstable"))
    return read(spark, manifest).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
