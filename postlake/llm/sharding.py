"""Consistent-hash sharding with bounded loads (operator 7), by DataFrame functions only.

Each shard owns ``vnodes`` points of a ring of 65,536 cells; a document's cell is that of its key's md5. The
arc before each point belongs to the point's shard. A shard holds as many rows as its share of all rows (the
shares differ by one at most). Arcs are filled by turns: first each gives its rows to its own shard, in ring
order, up to what that may hold; what overflows continues clockwise to the next other shard, and so on, so
every row finds a place after as many turns as there are shards. An arc's rows go in the order of md5, key,
size and checksum, so a shard gets ranges of ranks, and a row's place follows from its rank in its arc.

What passes through the driver is one count for each point of the ring (shards * vnodes numbers, whatever the
input). Ranks come from counts by cell plus a window inside a cell, a 65,536th of the rows.

The law that holds is ``rows``: counts are at most one apart. Bounded loads move some rows between old shards
when a shard is added, so ``key`` can't hold, and grown_shard is null.

Defined results: a null text has no bytes (size 1, checksum 0) and is placed like any other; a null key lies
where empty text lies; repeated rows each get a slot of their own; an empty table gives an empty table; only
key and text are read, so further columns can have any name.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import written

SHARDS, VNODES = 8, 128
CELLS = 1 << 16
#: A row that is repeated more often than this is dealt out in blocks before it is repeated.
BLOCK = 4096


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of each point, clockwise; of points in one cell the smallest shard's stays."""
    points = sorted((int(hashlib.md5(f"{shard}-{v}".encode()).hexdigest()[:4], 16), shard) for shard in range(shards) for v in range(vnodes))
    return [p for i, p in enumerate(points) if not i or points[i - 1][0] != p[0]]


def clockwise(points: list[tuple[int, int]], at: int) -> list[int]:
    """The shards as they first follow from a point on."""
    return list(dict.fromkeys(points[(at + i) % len(points)][1] for i in range(len(points))))


def allocate(counts: list[int], orders: list[list[int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot) of each range of an arc's ranks."""
    left, given, room, parts = list(counts), [0] * len(counts), list(capacity), []
    for turn in range(len(capacity)):
        for arc, order in enumerate(orders):
            if turn < len(order) and (n := min(left[arc], room[order[turn]])):
                shard = order[turn]
                parts.append((arc, given[arc], given[arc] + n, shard, capacity[shard] - room[shard]))
                left[arc], given[arc], room[shard] = left[arc] - n, given[arc] + n, room[shard] - n
    return parts


def table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from values that the driver has, as a literal of the plan."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip((c.split()[0] for c in schema.split(",")), r, strict=True)) for r in rows])), f"array<struct<{schema}>>")))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """key, size, text_crc32, shard and slot of each row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc")).groupBy("key", "size", "crc").agg(F.count("*").alias("copies"))
    digest = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = written(rows.select("*", digest.alias("digest"), F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").alias("cell")), "shard-rows")

    points = ring(shards, vnodes)
    spans = [(points[i - 1][0] + 1 if i else 0, cell, i) for i, (cell, _) in enumerate(points)]
    if points[-1][0] + 1 < CELLS:
        spans.append((points[-1][0] + 1, CELLS - 1, 0))  # past the last point, on to the first
    cells = table(spark, spans, "lo int, hi int, arc int").select(F.explode(F.sequence("lo", "hi")).alias("cell"), "arc", (F.col("lo") > points[-1][0]).alias("wraps"))
    filled = F.broadcast(rows.groupBy("cell").agg(F.sum("copies").alias("n"))).join(cells, "cell")  # a row for each of CELLS at most
    along = Window.partitionBy("arc").orderBy(F.desc("wraps"), "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = filled.select("cell", "arc", "n", (F.sum("n").over(along) - F.col("n")).alias("before"))
    counts = [0] * len(points)
    for row in starts.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # a row for each point at most
        counts[row.arc] = row.n
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    parts = table(spark, allocate(counts, [clockwise(points, i) for i in range(len(points))], capacity), "arc int, first long, stop long, shard int, base long")

    inside = Window.partitionBy("cell").orderBy("digest", "key", "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("within", F.sum("copies").over(inside) - F.col("copies")).join(F.broadcast(starts.select("cell", "arc", "before")), "cell")
    blocks = ranked.select("key", "size", "crc", "arc", "copies", (F.col("before") + F.col("within")).alias("rank"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long"))).alias("block"))
    each = blocks.select("key", "size", "crc", "arc", F.explode(F.sequence(F.col("rank") + F.col("block"), F.col("rank") + F.least(F.col("block") + BLOCK, F.col("copies")) - 1)).alias("rank"))
    placed = each.join(F.broadcast(parts), "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    return placed.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))


def op7_ring_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose counts are at most one apart."""
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql(shards: int = SHARDS, vnodes: int = VNODES) -> str:
    """The same in DuckDB SQL: checksums by a table of 256 entries, turns by windows over the arcs."""
    turns = "".join(
        f""",
turn{t} AS (SELECT a.arc, o.shard, greatest(0, least(a.lft, r.room - coalesce(sum(a.lft) OVER (PARTITION BY o.shard ORDER BY a.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n, a.given, r.cap - r.room AS used
  FROM left{t} a JOIN orders o ON o.arc = a.arc AND o.turn = {t} JOIN room{t} r ON r.shard = o.shard),
part{t} AS (SELECT arc, given AS first, given + n AS stop, shard, used + coalesce(sum(n) OVER (PARTITION BY shard ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM turn{t}),
left{t + 1} AS (SELECT a.arc, a.lft - coalesce(b.n, 0) AS lft, a.given + coalesce(b.n, 0) AS given FROM left{t} a LEFT JOIN turn{t} b USING (arc)),
room{t + 1} AS (SELECT r.shard, r.cap, r.room - coalesce((SELECT sum(n) FROM turn{t} b WHERE b.shard = r.shard), 0) AS room FROM room{t} r)"""
        for t in range(shards)
    )
    return f"""
WITH crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS b FROM documents),
sums AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM bytes, crc_table),
keyed AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '')) AS digest, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT AS cell FROM sums),
points AS (SELECT cell, shard, row_number() OVER (ORDER BY cell) - 1 AS arc, count(*) OVER () AS np FROM
  (SELECT ('0x' || substr(md5(s || '-' || v), 1, 4))::INT AS cell, min(s) AS shard FROM range({shards}) a(s), range({vnodes}) b(v) GROUP BY 1)),
orders AS (SELECT arc, shard, row_number() OVER (PARTITION BY arc ORDER BY gap) - 1 AS turn FROM
  (SELECT p.arc, q.shard, min((q.arc - p.arc + p.np) % p.np) AS gap FROM points p, points q GROUP BY 1, 2)),
located AS (SELECT k.*, coalesce(p.arc, 0) AS arc, p.arc IS NULL AS wraps FROM keyed k ASOF LEFT JOIN points p ON k.cell <= p.cell),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY wraps DESC, digest, doc_id, size, crc) - 1 AS rnk FROM located),
left0 AS (SELECT p.arc, coalesce(n, 0) AS lft, 0 AS given FROM points p LEFT JOIN (SELECT arc, count(*) AS n FROM ranked GROUP BY 1) USING (arc)),
room0 AS (SELECT s AS shard, n // {shards} + (s < n % {shards})::INT AS cap, n // {shards} + (s < n % {shards})::INT AS room FROM range({shards}) a(s), (SELECT count(*) AS n FROM documents)){turns},
parts AS ({" UNION ALL ".join(f"SELECT * FROM part{t}" for t in range(shards))})
SELECT r.doc_id, r.size::BIGINT AS size, r.crc::BIGINT AS text_crc32, 'rows' AS law, p.shard::INT AS shard, (p.base + r.rnk - p.first)::BIGINT AS slot, NULL::INT AS grown_shard
FROM ranked r JOIN parts p ON p.arc = r.arc AND r.rnk >= p.first AND r.rnk < p.stop
"""
