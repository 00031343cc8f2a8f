"""Merkle dataset manifest by traversal of aligned blocks (operator 13).

Each row is a leaf, the hash of its fields; a source's leaves in the order of ids are the bottom of a tree of RUN
branches, and the sources' roots are the bottom of another one, whose root names the whole table. A leaf's proof is
the siblings on its way up. H is SHA-256 in lowercase hex of its inputs, joined; digests go in as hex text, and are
stored as 32 bytes.

1. Leaves are hashed by built-in functions, and so is each leaf as it would be after tampering; both are written.
2. Ranks: rows are dealt by ranges of (source, id, digest, row number), which split a source of any size, and sorted
   in their range; a row's rank is its place there plus the rows of its source in the ranges before. What is summed
   is a row for each range and source.
3. Blocks: RUN**HEIGHT leaves in a row whose ranks begin at a multiple of that are a whole subtree. Each becomes one
   row: its packed leaves, and its root.
4. Blocks' roots are the leaves of the tree above: steps 3 to 5 on them give each block the path above it, and so do
   sources' roots (each level has RUN**HEIGHT times fewer rows, so this is short).
5. In each block the traversal goes leaf by leaf. For each level it holds the run that the present leaf's siblings
   are in, and a stack that builds the next such run from the leaves ahead, one leaf a step, so that the run is there
   when it is needed. That is 2 * RUN digests and a stack a level, whatever the block's size. A leaf's path is its
   siblings within the block; the upper path, which all leaves of the block share, is appended.

Defined results: fields that are null are written as "-", empty texts as "0:"; a null source is a source of its own,
before all others; null ids come first in their source, then rows by id, and rows of one id by their leaf; repeated
rows are leaves each; an empty table has no rows and no root; only doc_id, source, lang, n_chars and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import LOWER, UPPER, forget, remainder, small_batches, written

RUN, HEIGHT = 16, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A level of a path: the node's place in its run, and the other nodes, left to right.
PATH = "array<struct<place: int, siblings: binary>>"


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """H of fields, each "-" if null, else its number of UTF-8 bytes, a colon and itself."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*each), 256))


def ranked(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with rank (from 0) and total within ``by``, a column without nulls. Rows are dealt by ranges, so what one value of ``by`` has is spread; the orders should tell rows apart."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    dealt = written(dealt.select("*", F.spark_partition_id().alias("range"), place.alias("place")), "ranges")
    pieces = dealt.groupBy(by, "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy(by)
    pieces = pieces.select(by, "range", (F.sum("n").over(own.orderBy("range")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total"))
    return dealt.join(pieces, [by, "range"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("rank"), "total")


def parents(nodes: list[str]) -> list[str]:
    return [h("".join(nodes[i : i + RUN])) for i in range(0, len(nodes), RUN)]


def raised(nodes: list[str], levels: int) -> str:
    """The one node that is left so many levels up."""
    for _ in range(levels):
        nodes = parents(nodes)
    (top,) = nodes
    return top


def levels_of(n: int) -> int:
    """How many levels lead from n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


class Ahead:
    """Builds the runs of one level from leaves, one at a time: a stack holds the started runs below."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]
        self.ready: list[str] = []

    def take(self, leaf: str) -> None:
        self.put(0, leaf)

    def put(self, level: int, node: str) -> None:
        self.stack[level].append(node)
        if len(self.stack[level]) == RUN:
            self.full(level)

    def full(self, level: int) -> None:
        run, self.stack[level] = self.stack[level], []
        if level + 1 == len(self.stack):
            self.ready = run
        elif run:
            self.put(level + 1, h("".join(run)))

    def end(self) -> None:
        """There are no more leaves: started runs are closed, from below."""
        for level in range(len(self.stack)):
            if self.stack[level]:
                self.full(level)


def traversal(leaves: Callable[[int], str], count: int, levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in turn, the levels of its path: (place in the run, the run). Runs are built from leaves ahead, each level one leaf a step."""
    ahead, now, at = [Ahead(level) for level in range(levels)], [[] for _ in range(levels)], [0] * levels

    def advance(level: int) -> None:
        if at[level] < count:
            ahead[level].take(leaves(at[level]))
            at[level] += 1
            if at[level] == count:
                ahead[level].end()

    for level in range(levels):  # the first runs
        for _ in range(RUN ** (level + 1)):
            advance(level)
    for i in range(count):
        for level in range(levels):
            if i % RUN ** (level + 1) == 0:
                now[level], ahead[level].ready = ahead[level].ready, []
            advance(level)
        yield [(i // RUN**level % RUN, now[level]) for level in range(levels)]


def packed(nodes: DataFrame, carried: list[str], height: int) -> DataFrame:
    """(by, block, total, nodes, root, carried columns as arrays): a row for each aligned block of nodes (by, rank, total, node)."""
    size = RUN**height
    rows = nodes.select("by", F.expr(f"rank div {size}").alias("block"), "total", "rank", "node", *carried)
    kinds = [f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in carried]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        total = table["total"][0].as_py()
        own = [x.hex() for x in table["node"].to_pylist()]
        root = raised(own, levels_of(total) if total <= size else height)
        values = [table["by"].slice(0, 1), table["block"].slice(0, 1), pa.array([total]), pa.array([bytes.fromhex("".join(own))], pa.binary()), pa.array([bytes.fromhex(root)], pa.binary())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]) for c in carried]
        return pa.table([*values, *lists], names=["by", "block", "total", "nodes", "root", *carried])

    return rows.groupBy("by", "block").applyInArrow(one, ", ".join(["by string, block long, total long, nodes binary, root binary", *kinds]))


def with_paths(blocks: DataFrame, upper: DataFrame | None) -> DataFrame:
    """blocks with the path above each: upper is (by, block, path), or None if every block is its whole tree."""
    none = F.array().cast(PATH)
    return blocks.withColumn("path", none) if upper is None else blocks.join(upper, ["by", "block"], "left").withColumn("path", F.coalesce("path", none))


def proven(blocks: DataFrame, carried: list[str], height: int, emit: Callable, schema: str) -> DataFrame:
    """What ``emit`` makes of each block (by, block, nodes, total, path, carried columns): it gets the row, a function for its leaves, the traversal and the upper path, and returns columns with a row for each leaf."""
    size = RUN**height

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = row["nodes"]
                leaf = lambda i, raw=raw: raw[32 * i : 32 * i + 32].hex()
                levels = levels_of(row["total"]) if row["total"] <= size else height
                yield emit(row | {"first": row["block"] * size}, leaf, traversal(leaf, len(raw) // 32, levels), [(p["place"], p["siblings"]) for p in row["path"]])

    return blocks.select("by", "block", "nodes", "total", "path", *carried).mapInArrow(walked, schema)


def path_of(levels: list[tuple[int, list[str]]], shared: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    return [(place, bytes.fromhex("".join(run[:place] + run[place + 1 :]))) for place, run in levels] + shared


def emit_paths(row: dict, leaf: Callable[[int], str], walk: Iterator, shared: list) -> pa.RecordBatch:
    """(by, rank, path) of each node of a block."""
    first = row["first"]
    paths = [[{"place": p, "siblings": s} for p, s in path_of(levels, shared)] for levels in walk]
    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.binary())]))
    return pa.RecordBatch.from_arrays([pa.array([row["by"]] * len(paths), pa.string()), pa.array(range(first, first + len(paths)), pa.int64()), pa.array(paths, kind)], ["by", "rank", "path"])


def climbed(blocks: DataFrame, height: int, tables: list[DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """For blocks of trees: (by, block, path) above each block up to its tree's root, None if no tree has several blocks; and (by, root)."""
    size = RUN**height
    alone = blocks.where(F.col("total") <= size).select("by", "root")
    several = blocks.where(F.col("total") > size)
    if several.limit(1).count() == 0:
        return None, alone
    above = written(packed(several.select("by", F.col("block").alias("rank"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("root").alias("node")), [], height), "blocks")
    tables.append(above)
    upper, roots = climbed(above, height, tables)
    paths = written(proven(with_paths(above, upper), [], height, emit_paths, f"by string, rank long, path {PATH}").withColumnRenamed("rank", "block"), "paths")
    tables.append(paths)
    return paths, alone.unionByName(roots)


def trees(blocks: DataFrame, height: int, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(by, block, path up to the root of all, subroot) for each block of trees, and the one row (root)."""
    within, subroots = climbed(blocks, height, tables)
    subroots = written(subroots, "subroots")
    tops = written(packed(ranked(subroots.select(F.lit("").alias("by"), F.col("by").alias("tree"), F.col("root").alias("node")), "by", "tree"), ["tree"], height), "blocks")
    over, root = climbed(tops, height, tables)

    def emit(row: dict, leaf: Callable[[int], str], walk: Iterator, shared: list) -> pa.RecordBatch:
        out = emit_paths(row, leaf, walk, shared)
        return pa.RecordBatch.from_arrays([pa.array(row["tree"], pa.string()), out.column(2)], ["tree", "path"])

    across = proven(with_paths(tops, over), ["tree"], height, emit, f"tree string, path {PATH}").select(F.col("tree").alias("by"), F.col("path").alias("across"))
    each = with_paths(blocks.select("by", "block"), within).join(across, "by").join(subroots.withColumnRenamed("root", "subroot"), "by")
    tables += [subroots, tops]
    return written(each.select("by", "block", F.concat("path", "across").alias("path"), "subroot"), "upper"), root.select("root")


def digests(siblings: bytes) -> list[str]:
    text = siblings.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def folded(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for place, others in path:
        leaf = h("".join([*others[:place], leaf, *others[place:]]))
    return leaf


def leaves(docs: DataFrame, changed: Column | None = None, tampered: Column | None = None) -> DataFrame:
    """Written rows (doc_id, by, node, other, uid): other is the leaf with ``changed`` for the text where ``tampered``, else null."""
    fields = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("binary") if changed is None else F.when(tampered, leaf_of([*fields[:-1], changed]))
    by = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return written(docs.select("doc_id", by.alias("by"), leaf_of(fields).alias("node"), other.alias("other"), F.monotonically_increasing_id().alias("uid")), "leaves")


def strings(values: Iterator[str]) -> pa.Array:
    return pa.array(list(values), pa.string())


def emit_proofs(row: dict, leaf: Callable[[int], str], walk: Iterator, shared: list) -> pa.RecordBatch:
    """Leaves with their whole proofs."""
    n = len(row["doc_id"])
    same = lambda x: pa.array([x] * n, pa.string())
    paths = emit_paths(row, leaf, walk, shared).column(2)
    columns = [pa.array(row["doc_id"]), same(row["by"][1:] if row["by"] else None), strings(map(leaf, range(n))), same(row["subroot"].hex()), same(row["top"].hex()), paths]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "leaf", "subroot", "root", "proof"])


def emit_digests(row: dict, leaf: Callable[[int], str], walk: Iterator, shared: list) -> pa.RecordBatch:
    """Leaves with the digest of their siblings, and the root that the tampered leaf or else the leaf itself gives."""
    top, n = row["top"].hex(), len(row["doc_id"])
    above = [(place, digests(siblings)) for place, siblings in shared]
    tail = "".join(x for _, others in above for x in others)
    proofs, roots = [], []
    for i, levels in enumerate(walk):
        own = [(place, run[:place] + run[place + 1 :]) for place, run in levels]
        proofs.append(h("".join([*("".join(others) for _, others in own), tail])))
        roots.append(folded(row["other"][i].hex() if row["other"][i] is not None else leaf(i), own + above))
    same = lambda x: pa.array([x] * n, pa.string())
    columns = [pa.array(row["doc_id"], pa.int64()), strings(map(leaf, range(n))), same(row["subroot"].hex()), same(top), strings(proofs), strings(roots), pa.array([r == top for r in roots])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, changed: Column | None = None, tampered: Column | None = None, emit: Callable = emit_proofs, schema: str = f"doc_id long, source string, leaf string, subroot string, root string, proof {PATH}", height: int = HEIGHT) -> DataFrame:
    """A row for each document: doc_id, source, leaf, subroot, root (hex), and its proof, level by level. With another ``emit`` and its schema what that returns for blocks, which may use the leaves of ``tampered`` rows with ``changed`` for the text. Blocks have RUN**height leaves; results don't depend on it."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = leaves(docs, changed, tampered)
    carried = ["doc_id", "other"]
    blocks = written(packed(ranked(rows, "by", "doc_id", "node", "uid"), carried, height), "blocks")
    tables = [rows, blocks]
    upper, root = trees(blocks, height, tables)
    tables.append(upper)
    top = next((r.root for r in root.collect()), None)  # one digest, or none for an empty table
    whole = blocks.drop("root").join(upper, ["by", "block"]).withColumn("top", F.lit(top).cast("binary"))
    out = written(proven(whole, [*carried, "subroot", "top"], height, emit, schema), "manifest")
    forget(*tables)
    return out


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Manifest of documents, with the proofs of a fifth of them folded from a tampered leaf."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return manifest(docs, F.translate("text", UPPER, LOWER), remainder(F.col("doc_id"), 5) == 0, emit_digests, schema)


def oracle_sql(levels: int = 5, above: int = 3) -> str:
    """The same in DuckDB SQL, for at most 16**levels rows of a source and 16**above sources."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    def tree(t: str, n: int) -> str:
        """From {t}0 (src, i, node, c: the number of nodes) its levels, and {t}s0 to {t}s{n - 1} with what stands left and right of each node."""
        run, out = "PARTITION BY src, i // 16 ORDER BY i ROWS BETWEEN", ""
        for level in range(n):
            out += f""",
{t}{level + 1} AS (SELECT src, i // 16 AS i, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE any_value(node) END AS node, (any_value(c) + 15) // 16 AS c FROM {t}{level} GROUP BY src, i // 16),
{t}s{level} AS (SELECT src, i, c > 1 AS up, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {t}{level})"""
        return out

    climb, last = "", "f0"
    for step, (t, level, by, place) in enumerate([("t", x, "f.src", f"f.r // {16**x}") for x in range(levels)] + [("u", x, "''", f"f.o // {16**x}") for x in range(above)]):
        last = f"f{step + 1}"
        climb += f""",
{last} AS (SELECT f.* REPLACE (f.proof || s.lft || s.rgt AS proof, CASE WHEN s.up THEN sha256(s.lft || f.cur || s.rgt) ELSE f.cur END AS cur) FROM f{step} f JOIN {t}s{level} s ON s.src = {by} AND s.i = {place})"""
    return f"""
WITH crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
crcs AS (SELECT *, coalesce('=' || source, '') AS src, {leaf("text")} AS leaf, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: CASE WHEN x = '' THEN NULL ELSE ascii(x) END::BIGINT)), lambda c, x: CASE WHEN x IS NULL THEN c ELSE xor(c >> 8, t[(xor(c, x) & 255) + 1]) END), 4294967295::BIGINT) AS crc FROM documents, crc_table),
d AS (SELECT doc_id, src, leaf, CASE WHEN crc % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE leaf END AS cur, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM crcs),
t0 AS (SELECT src, r AS i, leaf AS node, count(*) OVER (PARTITION BY src) AS c FROM d){tree("t", levels)},
subs AS (SELECT src, node AS subroot, row_number() OVER (ORDER BY src) - 1 AS o FROM t{levels}),
u0 AS (SELECT '' AS src, o AS i, subroot AS node, count(*) OVER () AS c FROM subs){tree("u", above)},
f0 AS (SELECT d.*, subs.subroot, subs.o, '' AS proof FROM d JOIN subs USING (src)){climb}
SELECT doc_id, leaf, subroot, u{above}.node AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u{above}.node AS verified FROM {last}, u{above}
"""
