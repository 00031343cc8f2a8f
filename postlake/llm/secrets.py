"""Secret scans (operator 6): three patterns, and windows of high entropy.

The base kinds are ``assign`` (a value given to something named like a password), ``access`` (access key ids)
and ``hex`` (long hexadecimal runs). The method adds ``entropy``: candidate strings are runs of at least
``WINDOW`` characters that keys and tokens are made of. In a candidate, each run of one character class is
passed over by a window whose Shannon entropy is kept by counts that change by one character in and one out;
windows at or above their class's threshold are joined to spans. A span is suppressed if it is on the
allow-list: strings that are known examples or placeholders, words (letters only, of one case or with a
capital first), and numbers.

Defined results: null and empty texts have no spans; long texts are scanned whole; repeated rows are reported
each; a null key stays null; only key and text are read. Spans are in code points, end exclusive, by start,
then kind as listed in KINDS.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import small_batches

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as runs of any length, of which the shorter ones are dropped
LEAST = {"assign": 6, "access": 20}

WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Class, its characters, and the bits a character from which a window counts. Twenty random hexadecimal digits have about 3.4 bits, twenty random letters and digits about 4.0.
CLASSES = (("hex", re.compile(rf"[0-9a-fA-F]{{{WINDOW},}}"), 3.0), ("base64", re.compile(rf"[A-Za-z0-9+/]{{{WINDOW},}}"), 3.75), ("url", re.compile(rf"[A-Za-z0-9_=-]{{{WINDOW},}}"), 3.75))
ALLOWED = re.compile(r"(?i:.*(example|sample|dummy|placeholder|changeme|xxxxxx|abcdef0123456|0123456789))|[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Z]?[a-z]+([/_=+-]+[A-Z]?[a-z]*)+|[0-9]+([/_=+-]+[0-9]*)+")
#: n * log2(n) of the counts in a window.
TERM = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]


def windows(text: str, least_bits: float, width: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Joined spans of windows of text whose entropy is at least least_bits."""
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    bound = width * (math.log2(width) - least_bits) + 1e-9  # entropy = log2(width) - total / width
    for i, c in enumerate(text):
        if i >= width:
            out = text[i - width]
            n = counts[out]
            counts[out] = n - 1
            total += TERM[n - 1] - TERM[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += TERM[n + 1] - TERM[n]
        if i >= width - 1 and total <= bound:
            if start >= 0 and i - width + 1 > end:
                yield start, end
                start = -1
            start = i - width + 1 if start < 0 else start
            end = i + 1
    if start >= 0:
        yield start, end


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found = set()
    for candidate in CANDIDATE.finditer(text):
        whole = candidate.group()
        if ALLOWED.fullmatch(whole):
            continue
        for _, runs, bits in CLASSES:
            for run in runs.finditer(whole):
                for a, b in windows(run.group(), bits):
                    a, b = candidate.start() + run.start() + a, candidate.start() + run.start() + b
                    if not ALLOWED.fullmatch(text, a, b):
                        found.add((a, b))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(a, 3, b) for a, b in entropy_spans(text)]
    return sorted(out)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with each maximal stretch of spans replaced by a mark that no pattern finds again."""
    out, at, k = [], 0, 0
    while k < len(found):
        start, _, end = found[k]
        while k + 1 < len(found) and found[k + 1][0] < end:
            k += 1
            end = max(end, found[k][2])
        out += [text[at:start], "[secret]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (an array of kind, start, end) of each row."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], ["key", "spans"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(scanned, f"key {rows.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets of its texts replaced; rows without secrets, and null texts, as they are."""

    @F.pandas_udf("string")
    def clean(series):
        return series.map(lambda x: redact(x, spans(x)) if x else x)

    small_batches(docs.sparkSession)
    return docs.withColumn(text, clean(F.col(text)))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The spans of every whole text of documents, counted by base kind and digested."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "entropy"), line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
