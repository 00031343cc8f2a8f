"""Filter interaction audit over a packed bitmap index (operator 11).

Five filters judge every document; what each of them removes depends on the order in which they run. For all 120
orders the audit says, part by part, what a filter keeps and removes at its step, what it would have removed had
nothing run before it, what it alone removes, which good and toxic documents go, and its Shapley sum.

1. One pass over the texts gives each document its bits: the filters that see one text alone, as built-in
   expressions. A SHA-256 digest stands for the text; those rows are written, so that texts are read once.
2. Repeats: the smallest id of each digest is aggregated (map sides keep one row a digest), and rows look
   themselves up by digest *and* id, so a group of copies is dealt out by its ids and no digest is hot.
3. Labels come by id, each id's label rows merged first.
4. In each partition rows become a packed bitmap index, a batch at a time: a NumPy bitset for each filter, label
   and part. Rows of a part lie side by side and each part begins on a byte of its own, so a part's bitset is a
   range of bytes. For each of the 32 sets of filters the survivors are rows AND NOT the filters' bitsets; their
   bits are counted for all parts at once, alone and ANDed with each label.
5. Counts of partitions are summed: 32 rows for each part and partition. What holds for an order and a step follows
   from the counts of the set of filters before it and the set with it, for each of the 120 orders.

A worker holds the bitsets of one batch and counts of at most PARTS parts; more parts are handed on early. Nothing
passes through the driver.

Defined results: a null text is an empty one; a null source is the part of the empty string; a null id has no
labels, is never a repeat and makes no other row one; rows of one id and text are not each other's repeats (no id
is smaller); of several label rows of an id any 1 counts; other labels than 1 and nulls don't count; an empty table
has no parts; only doc_id, text, source and labels' doc_id, quality and toxic are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import forget, written

FILTERS = "ABCDE"
LABELS = ["quality", "toxic"]
PARTS = 4096


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A to D: few words, repeated words, capitals, marks."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def bits_of(conditions: list[Column], at: int = 0) -> Column:
    """A number whose bits from ``at`` on are conditions; null is false."""
    bits = F.lit(0)
    for i, c in enumerate(conditions, at):
        bits = bits + F.when(c, F.lit(1 << i)).otherwise(0)
    return bits.cast("int")


def survivors(part: pa.Array, bits: np.ndarray, filters: int, labels: int) -> tuple[pa.Array, np.ndarray]:
    """The parts of a batch, and for each part and set of filters how many rows survive the set: in all, and with each label."""
    coded = part.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    rows = np.bincount(code, minlength=len(coded.dictionary))
    begins = np.concatenate([[0], np.cumsum(-(-rows // 8))])
    firsts = np.cumsum(rows) - rows
    place = 8 * begins[code[order]] + np.arange(len(code)) - firsts[code[order]]

    def bitset(flags: np.ndarray) -> np.ndarray:
        plane = np.zeros(8 * begins[-1], np.uint8)
        plane[place] = flags[order]
        return np.packbits(plane)

    fails = [bitset((bits >> i) & 1) for i in range(filters)]
    marks = [bitset((bits >> i) & 1) for i in range(filters, filters + labels)]
    alive = [bitset(np.ones(len(bits), np.uint8))]
    out = np.zeros((len(rows), 1 << filters, 1 + labels), np.int64)
    for s in range(1 << filters):
        if s:
            low = (s & -s).bit_length() - 1
            alive.append(alive[s & (s - 1)] & ~fails[low])
        for j, kept in enumerate([alive[s], *(alive[s] & m for m in marks)]):
            out[:, s, j] = np.add.reduceat(np.bitwise_count(kept).astype(np.int64), begins[:-1])
    return coded.dictionary, out


def set_counts(rows: DataFrame, filters: int, labels: int) -> DataFrame:
    """(part, counts) of rows (part string, bits int; bits of filters, then of labels): counts[s] holds how many rows of the part survive the set s of filters, in all and with each label."""
    most, names = PARTS, ["part", "s", *(f"n{j}" for j in range(1 + labels))]
    schema = pa.schema([("part", pa.string()), ("s", pa.int32()), *((n, pa.int64()) for n in names[2:])])

    def table(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        sums = np.concatenate(list(held.values()))
        columns = [pa.array(np.repeat(np.array(list(held), object), 1 << filters), pa.string()), pa.array(np.tile(np.arange(1 << filters, dtype=np.int32), len(held))), *(pa.array(c) for c in sums.T)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, sums = survivors(batch.column(0), batch.column(1).to_numpy(), filters, labels)
            for part, own in zip(parts.to_pylist(), sums, strict=True):
                held[part] = held[part] + own if part in held else own
            if len(held) > most:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    each = rows.select("part", "bits").mapInArrow(counted, "part string, s int, " + ", ".join(f"{n} long" for n in names[2:]))
    summed = each.groupBy("part", "s").agg(*(F.sum(n).alias(n) for n in names[2:]))
    return summed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("counts"))  # a row for each set of filters


def steps(filters: str) -> list[dict]:
    """Each order's steps: which filter runs (from 0), after which set of filters, and which set has run then."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"o": "".join(filters[i] for i in order), "step": step, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    return out


def by_order(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, lost (an array, one number for each label) and shapley."""
    k, every = len(filters), (1 << len(filters)) - 1
    labels = len(counts.schema["counts"].dataType.elementType.fields) - 2

    def n(s: int | Column, j: int = 0) -> Column:
        return F.col("counts")[s][f"n{j}"]

    alone = [n(0) - n(1 << i) for i in range(k)]
    unique = [n(every ^ (1 << i)) - n(every) for i in range(k)]
    shapley = [sum(((n(s) - n(s | 1 << i)) * (factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in range(1 << k) if not s >> i & 1), F.lit(0)) for i in range(k)]
    literal = F.from_json(F.lit(json.dumps(steps(filters))), "array<struct<o: string, step: int, f: int, before: int, after: int>>")
    x = F.col("x")
    removed = n(x["before"]) - n(x["after"])
    own = lambda values: F.array(*values)[x["f"]].cast("long")
    return counts.select("part", "counts", F.explode(literal).alias("x")).select(
        "part",
        x["o"].alias("filter_order"),
        x["step"].alias("step"),
        n(x["after"]).alias("kept"),
        removed.alias("removed"),
        (own(alone) - removed).alias("redundant"),
        own(unique).alias("unique_fails"),
        F.array(*(n(x["before"], j) - n(x["after"], j) for j in range(1, 1 + labels))).alias("lost"),
        own(shapley).alias("shapley"),
    )


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits) of each document: bits of A to E, then of labels."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits_of(text_failures(F.col("text"))).alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest")), "flags")
    named = rows.where("doc_id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    ones = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(bits_of([F.max(F.coalesce(F.col(c) == 1, F.lit(False))) for c in LABELS], len(FILTERS)).alias("marks"))
    repeat = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(0)
    joined = named.join(firsts, ["digest", "doc_id"], "left").join(ones, "doc_id", "left")
    return joined.select("part", (F.col("bits") + repeat + F.coalesce("marks", F.lit(0))).cast("int").alias("bits")).unionByName(rows.where("doc_id IS NULL").select("part", "bits"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents and labels."""
    counts = by_order(set_counts(marked(docs, labels), len(FILTERS), len(LABELS)))
    return counts.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("lost")[0].alias("good_lost"), F.col("lost")[1].alias("toxic_lost"), "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """What each filter removes, in each order and part of documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Simulates every order on the groups of rows that fail the same filters.
ORACLE = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN m USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
o AS (SELECT a || b || c || d || e AS filter_order FROM unnest(['A', 'B', 'C', 'D', 'E']) t(a), unnest(['A', 'B', 'C', 'D', 'E']) u(b), unnest(['A', 'B', 'C', 'D', 'E']) v(c), unnest(['A', 'B', 'C', 'D', 'E']) x(d), unnest(['A', 'B', 'C', 'D', 'E']) y(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
x AS (SELECT g.part, s.filter_order, s.step, s.own, g.n, g.good, g.toxic, contains(fails, own) AS hit, earlier <> '' AND regexp_matches(fails, '[' || earlier || '-]') AS gone, fails = own AS alone FROM g, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
