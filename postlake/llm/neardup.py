"""MinHash near-dedup with SetSketch registers (operator 3).

A document's set is its distinct n-word shingles. One pass sketches every text: register i holds the level of
the smallest exponentially distributed hash of its shingles, levels being spaced by powers of BASE and
truncated to one byte. Sketches of parts of a text merge by taking the larger level of each register, and equal
levels show similar sets. Then

1. texts with equal sets form classes, of which one text stands for all;
2. registers side by side are a band; classes that agree in a band share a bucket. A band has as many registers
   as leave a pair at the threshold without a shared bucket with a probability of MISSED at most;
3. candidate pairs are estimated: the likelihood of the registers' order relations gives how well the
   threshold can be true; pairs for which it is e**-SURE times less likely than the best value are dropped;
4. the rest are verified on the full sets, rebuilt from whole texts; what passes is a link;
5. links are joined to components by label propagation with pointer jumping.

Steps 3 to 5 run in turns. At first each class is compared with one other, the one that leads most of its
buckets, and what leads a bucket is the member with most neighbours: the original of a group of near copies, say.
Then, where buckets still hold several components, members of the smaller ones are compared with ASKED random
members of the largest. Both turns list no pairs of a group, only a few for each class, and so do their links.

Pairs of the components that then share a bucket are found exactly, by prefix filtering: in any one order of
shingles, two sets at the threshold share one of the first n - ceil(t * n) + 1 of each (fewer of the smaller
set), and what follows the first one shared bounds how many they share. The order puts first what joins no two
components, then the shingles of fewest documents, by counts of all shingles of these texts; so a passage that
many documents share joins no pairs, at any size of the table. No link between components is lost.

Defined results: null texts and texts without words have an empty set, are linked with nothing and kept; texts
with fewer words than a shingle have one shingle, their whole sequence; rows with equal sets are linked;
repeated rows are reported each; a component takes the smallest id that isn't null, and rows whose component
has no id have a null component and are kept; only key and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import forget, mixed, small_batches, written
from postlake.llm.shingles import parts, shingle_sql, shingles

REGISTERS, BASE, TOP = 400, 1.1, 255
MISSED = 1e-6
SURE = 14.0
ASKED = 4
COPIES = 32
TEXT_PARTS = 4
MULTIPLY = (mixed(np.arange(20_000, 20_000 + REGISTERS, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
ADD = mixed(np.arange(40_000, 40_000 + REGISTERS, dtype=np.uint64)).astype(np.uint32)


@functools.cache
def level_bounds() -> np.ndarray:
    """Hashes in ascending order at which a register's level falls by one. The exponential of a hash v is -log(1 - (v + 0.5) / 2**32); its level is 1 - log(it) / log(BASE)."""
    return np.floor(-np.expm1(-(float(BASE) ** -np.arange(TOP - 1.0, -1.0, -1.0))) * 2.0**32 - 0.5)


@functools.cache
def band_rows(least: tuple[int, int]) -> int:
    """The most registers in a band with which a pair at the threshold shares no bucket with a probability of MISSED at most."""
    most, t = 1, least[0] / least[1]
    same = 1 + 2 * np.log1p(-(1 - t) / 2 * (BASE - 1) / BASE) / np.log(BASE)  # of two sets of one size, a register is equal with this probability
    for rows in range(1, 17):
        if (1 - same**rows) ** (REGISTERS // rows) <= MISSED:
            most = rows
    return most


def levels(minima: np.ndarray) -> np.ndarray:
    return (TOP - np.searchsorted(level_bounds(), minima, "left")).astype(np.uint8)


def sketches(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Registers of the sets of hashes that begin at the given places (none of them empty)."""
    x = hashes.astype(np.uint32)
    out = np.empty((len(begins), REGISTERS), np.uint8)
    for i in range(REGISTERS):
        out[:, i] = levels(np.minimum.reduceat(MULTIPLY[i] * x + ADD[i], begins))
    return out


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted, and where each text's begin."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[first], np.concatenate([[0], np.cumsum(np.bincount(o[first], minlength=len(at) - 1))])


def names(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Sixteen bytes for each set that tell sets apart."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.zeros((len(at) - 1, 2), np.uint64)
    with np.errstate(over="ignore"):
        for j, salt in enumerate((0x1234567, 0x89ABCDEF)):
            np.add.at(out[:, j], owner, mixed(hashes ^ np.uint64(salt)))
    return [row.tobytes() for row in mixed(out)]


SKETCHED = pa.schema([("h", pa.int64()), ("k", pa.binary()), ("n", pa.int64()), ("regs", pa.binary())])


def sketch(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, h (hash of the text), k (its set's name), n (the set's size) and regs of each row; without words n is 0 and k null."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in parts(batch.column(2)):
                hashes, at = distinct(*shingles(batch.column(2).slice(start, stop - start), n))
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                regs = np.zeros((len(sizes), REGISTERS), np.uint8)
                if len(full):
                    regs[full] = sketches(hashes, at[full])
                rows = [batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), pa.array([k if s else None for k, s in zip(names(hashes, at), sizes, strict=True)], pa.binary()), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["key", *SKETCHED.names])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return rows.mapInArrow(sketched, f"key {rows.schema[0].dataType.simpleString()}, h long, k binary, n long, regs binary")


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of sketches of sets of known sizes leave a similarity of at least ``least`` possible: the joint likelihood of how many registers are larger, smaller and equal."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(np.maximum(u - v * j, 1e-12)), p(np.maximum(v - u * j, 1e-12))
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    most = np.minimum(na, nb) / np.maximum(na, nb)  # no pair is more similar than its sizes allow
    grid = np.linspace(0.0, 1.0, 41)
    best = np.max([log_likelihood(np.minimum(g, most)) for g in grid], axis=0)
    high = np.max([log_likelihood(np.minimum(np.maximum(g, least), most)) for g in np.linspace(least, 1.0, 8)], axis=0)
    return (most >= least - 1e-12) & (high >= best - SURE)


def estimated(pairs: DataFrame, classes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that their registers leave possible."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")).join(pairs, x)  # noqa: E731  of the registers only those of pairs move

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb")]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
            yield batch.select(["a", "b"]).filter(pa.array(plausible(*regs, *sizes, least[0] / least[1]))) if batch.num_rows else batch.select(["a", "b"])

    return side("a").join(side("b"), ["a", "b"]).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(kept, "a long, b long")


def text_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text of a column."""
    for start, stop in parts(column):
        hashes, at = distinct(*shingles(column.slice(start, stop - start), n))
        yield from (hashes[a:b] for a, b in zip(at, at[1:], strict=False))


def verified(pairs: DataFrame, texts: DataFrame, n: int, least: tuple[int, int]) -> DataFrame:
    """Those of the pairs whose full sets are similar enough."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(text_sets(batch.column(2), n), text_sets(batch.column(3), n), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(least[1] * shared >= least[0] * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: texts.select(F.col("c").alias(x), F.col("text").alias(f"t{x}")).join(pairs, x)
    return side("a").join(side("b"), ["a", "b"]).select("a", "b", "ta", "tb").mapInArrow(kept, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(c, comp) of each end of the links (a, b): the smallest end that can be reached. Labels go to neighbours and then to the label's label until none changes; each turn is written. A label that many ends have is looked up in COPIES parts."""
    ends = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    labels = written(ends.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("c")).alias("comp")), "labels")
    while True:
        near = ends.join(labels.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = written(labels.join(near.withColumnRenamed("a", "c"), "c").select("c", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")), "lower")
        jump = lower.where("comp != c").select(F.col("c").alias("comp"), F.col("comp").alias("next")).join(lower.select("comp").distinct(), "comp")
        jump = jump.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        turn = written(lower.withColumn("part", F.pmod(F.xxhash64("c"), F.lit(COPIES)).cast("int")).join(jump, ["comp", "part"], "left").select("c", F.coalesce("next", "comp").alias("comp"), "old"), "labels")
        changed = turn.where("comp != old").limit(1).count()
        forget(labels, lower)
        labels = turn.select("c", "comp")
        if not changed:
            forget(ends)
            return labels


def led(members: DataFrame, order: Column, fits: Column, most: int) -> DataFrame:
    """Pairs (a, b) of members (c, n, comp, bv) with leaders of their buckets, the members that come last in an order: for each up to ``most`` leaders of another component, those of most of its buckets first."""
    heads = members.groupBy("bv").agg(F.max_by("c", order).alias("b"), F.max_by("comp", order).alias("compb"), F.max_by("n", order).alias("nb"))
    met = members.join(heads, "bv").where((F.col("comp") != F.col("compb")) & fits).groupBy("c", "b").agg(F.count("*").alias("k"))
    best = met.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "b")), asc=False), 1, most).alias("best"))
    return best.select("c", F.explode("best.b").alias("b")).select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()


def prefixes(rest: DataFrame, n: int, least: tuple[int, int]) -> DataFrame:
    """(s, place, c, n, comp) of rest (c, n, comp, text): the hashes of each text's first shingles and their places from 1. Shingles that join no two components come first, and aren't listed; then those of fewest texts."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for start, stop in parts(batch.column(2)):
                hashes, begins = distinct(*shingles(batch.column(2).slice(start, stop - start), n))
                rows = batch.select([0, 1]).take(pa.array(np.repeat(np.arange(start, stop), np.diff(begins))))
                for at in range(0, len(hashes), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at : at + (1 << 17)].view(np.int64)), *(x.slice(at, 1 << 17) for x in rows.columns)], ["s", "c", "comp"])

    each = rest.select("c", "comp", "text").mapInArrow(items, "s long, c long, comp long")
    several = each.groupBy("s").agg(F.count("*").alias("texts"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("s", "texts")
    lists = each.select("s", "c").join(several, "s").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("texts", "s"))).alias("list"))
    size = F.col("n") - F.ceil(F.col("n") * least[0] / least[1]) + 1
    first = F.col("n") - F.size("list")
    cut = lists.join(rest.select("c", "n", "comp"), "c").where(size > first).select("c", "n", "comp", first.alias("first"), F.posexplode(F.slice("list", F.lit(1), (size - first).cast("int"))).alias("i", "x"))
    return cut.select("x.s", (F.col("first") + F.col("i") + 1).alias("place"), "c", "n", "comp")


def sharing(lists: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components that share one of their first shingles and can be similar enough."""
    other = lists.select("s", F.col("place").alias("placeb"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("compb"))
    # no more is shared than the first shared shingle and what follows it on either side; the smaller set's own size bounds that already
    enough = lambda follow, both: (1 + follow) * sum(least) >= least[0] * both
    smaller = lists.where(enough(F.col("n") - F.col("place"), 2 * F.col("n")))
    ordered = (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("c") < F.col("b")))
    bounded = enough(F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("placeb")), F.col("n") + F.col("nb"))
    near = F.col("n") * least[1] >= F.col("nb") * least[0]
    pairs = smaller.join(other, "s").where(bounded & ordered & near & (F.col("comp") != F.col("compb")))
    return pairs.select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()


def component_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """key, h (hash of the text), n_shingles and component_id of each row."""
    small_batches(docs.sparkSession)
    rows = written(sketch(docs, key, text, n), "sketches")
    # of each class one text to read again, by id and hash, and the smallest id
    pick = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("h").alias("h"))).alias("pick")
    classes = written(rows.where("n > 0").groupBy("k").agg(pick, F.first("n").alias("n"), F.first("regs").alias("regs")).withColumn("c", F.monotonically_increasing_id()), "classes")

    size = band_rows(least)
    bands = classes.select("c", F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("regs", i * size + 1, size)) for i in range(REGISTERS // size)))).alias("bv"))
    shared = bands.groupBy("bv").agg(F.count("*").alias("members")).where("members > 1")
    buckets = written(bands.join(shared, "bv"), "buckets")
    weights = buckets.groupBy("c").agg(F.sum("members").alias("weight"))
    about = written(classes.select("c", "n", F.col("pick.key").alias("key"), F.col("pick.h").alias("h")).join(weights, "c"), "about")
    # of classes that share no bucket nothing but names is needed from here on
    regs = written(classes.select("c", "n", "regs").join(about.select("c"), "c"), "registers")
    named, counted = written(classes.select("c", "k", "pick.key"), "names"), written(rows.select("key", "h", "n", "k"), "sizes")
    forget(rows, classes)
    # the texts of all classes that share a bucket, a part at a time: all texts move to be joined, and each part's shuffle files go before the next one
    slot = F.pmod(F.xxhash64("key", "h"), F.lit(TEXT_PARTS))
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    texts = None
    for i in range(TEXT_PARTS):
        found = source.where(slot == i).alias("d").join(about.select("c", "key", "h").where(slot == i).alias("w"), F.expr("d.h = w.h AND d.key <=> w.key"))
        part = written(found.select("c", "text").dropDuplicates(["c"]), "texts")
        texts = part if texts is None else texts.unionByName(part)
    tables = [regs, named, counted, buckets, about, texts]

    fits = F.least("n", "nb") * least[1] >= F.greatest("n", "nb") * least[0]
    members = buckets.select("c", "bv").join(about.select("c", "n", "weight"), "c").withColumn("comp", F.col("c"))
    links = None
    for turn in range(3):
        if turn:
            own = comps.join(comps.groupBy("comp").agg(F.count("*").alias("size")), "comp")
            members = buckets.select("c", "bv").join(about.select("c", "n"), "c").join(own, "c", "left").select("c", "bv", "n", F.coalesce("comp", "c").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
            several = members.groupBy("bv").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bv")
            members = members.join(several, "bv")
        if turn < 2:
            order = F.col("size") * (1 << 20) + F.pmod(F.xxhash64("c", "bv"), F.lit(1 << 20)) if turn else F.col("weight")
            pairs = led(members, order, fits, ASKED if turn else 1)
        else:
            rest = written(members.select("c", "n", "comp").distinct().join(texts, "c"), "rest")
            lists = written(prefixes(rest, n, least), "prefixes")
            pairs = sharing(lists, least)
            tables += [rest, lists]
        pairs = written(pairs, "pairs")
        likely = written(estimated(pairs, regs, least), "likely")
        new = written(verified(likely, texts, n, least), "links")
        tables += [pairs, likely, new]
        if links is None or new.head(1):
            links = new if links is None else links.unionByName(new)
            comps = components(links)
            tables.append(comps)

    low = comps.join(named, "c").groupBy("comp").agg(F.min("key").alias("low"))
    ids = written(named.join(comps.join(low, "comp").select("c", "low"), "c", "left").select("k", F.coalesce("low", "key").alias("component_id")), "components")
    out = written(counted.join(ids, "k", "left").select(F.col("key").alias(key), "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")), "rows")
    forget(*tables, ids)
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs of which one stays for each component: that with the smallest id (of repeats, one). All rows without an id or without words stay."""
    ids = component_ids(docs, key, text, n, least)
    first = ids.where((F.col("n_shingles") > 0) & (F.col(key) == F.col("component_id"))).groupBy(F.col(key).alias("kept_key")).agg(F.min("h").alias("kept_hash"))
    # names that no column of docs has
    a, b = (f"{x}_{len(''.join(docs.columns))}" for x in ("kept_key", "kept_hash"))
    first = first.select(F.col("kept_key").alias(a), F.col("kept_hash").alias(b))
    named = F.col(key).isNotNull() & F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.where(named).withColumns({a: F.col(key), b: F.xxhash64(text)})
    return marked.join(first, [a, b]).dropDuplicates([a, b]).select(docs.columns).unionByName(docs.where(~named))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of documents linked by three-word shingles at 0.85 or more."""
    ids = component_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, least=(85, 100))
    return ids.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = f"""
WITH RECURSIVE s AS ({shingle_sql("documents", "doc_id", 3)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id, min(r.y) = d.doc_id AS kept
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
