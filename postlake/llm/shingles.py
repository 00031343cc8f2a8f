"""Words and word shingles of whole texts as 64-bit hashes, a batch of texts at a time.

Words are runs of bytes other than the six ASCII white-space characters, with A-Z lowered. A text of at least
``n`` words has the shingles of n words in a row; one of fewer words, but some, has its whole sequence as its
only shingle; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from postlake.llm.common import mixed, words_of

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PART = 1 << 20


def parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a column of texts of about PART bytes, or of one text that is longer."""
    sizes, start, total = np.diff(offsets_of(column)), 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > PART:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.buffers()[1] is None:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts in order, and at which word each text begins (and the last ends)."""
    at = offsets_of(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    space = IS_SPACE[data]
    opens = ~space
    opens[1:] &= space[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    opens[begins] = ~space[begins]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(opens) - 1, 0)]
    place[place < 0] = 0
    place[space] = 0
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(place.max()) + 1, BASE, np.uint64))
        value = BYTE_VALUE[LOWERED[data]] * power[place]
        value[space] = 0
        hashes = mixed(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, at)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text of a column, in order with repeats, and at which each text's begin."""
    w, at = words(column)
    count = np.diff(at)
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(begins[-1], np.uint64)
    if not len(out):
        return out, begins
    texts = np.repeat(np.arange(len(count)), sizes)
    first = np.arange(len(out)) - begins[texts] + at[texts]
    with np.errstate(over="ignore"):
        for j in range(n):
            inside = j < count[texts]
            out = np.where(inside, mixed(out * STEP + w[np.minimum(first + j, len(w) - 1)] + np.uint64(j + 1)), out)
    return out, begins


def shingle_set(text: str | None, n: int) -> set[tuple[str, ...]]:
    """The same for one text as tuples of words: what hashes stand for."""
    found = words_of(text)
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if len(found) >= n else {tuple(found)} if found else set()


def shingle_sql(table: str, key: str, n: int) -> str:
    """DuckDB SQL for the distinct shingles of a table's texts."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
FROM (SELECT {key}, list_filter(string_split_regex(coalesce({lowered}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"""
