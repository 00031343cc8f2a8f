"""De-duplication: by id, by signature, near duplicates in buckets, and by vectors."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from postlake.functions.text import normal_text, signature, standard_company, standard_title
from postlake.operators.staging import staged

#: Names of a block that meet those of another in one group.
BLOCK = 1024
EPS = 1e-9


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the order. Taken by an aggregate, so map sides keep one candidate a key and a hot key costs no more than others."""
    rest = [c for c in df.columns if c not in keys]
    sort = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), sort).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def exact(postings: DataFrame) -> DataFrame:
    return first_per(postings, ["external_id"], F.col("doc_id"))


def by_signature(scored: DataFrame) -> DataFrame:
    """The most relevant posting of each signature."""
    return first_per(scored.withColumn("signature", signature(F.col("title"), F.col("company"), F.col("url"))), ["signature"], -F.col("relevance_score"), F.col("doc_id"))


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two texts, for which Spark has no function."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def indel_share(a: str, b: str) -> float:
    """1 - insertions and deletions over both lengths, by the longest common subsequence in bit vectors."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        used = state & masks.get(c, 0)
        state = (state + used) | (state - used)
    return 2 * (len(a) - (state & full).bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([indel_share(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def token_set(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The best of comparing shared tokens and each text's own ones."""
    for a, b in pairs:
        out = []
        for x, y in zip(a, b, strict=True):
            s, t = set(x.split()), set(y.split())
            both, left, right = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
            if not s or not t:
                out.append(0.0)
            elif both and (not left or not right):
                out.append(1.0)
            else:
                one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
                out.append(max([indel_share(one, two), *([indel_share(both, one), indel_share(both, two)] if both else [])]))
        yield pd.Series(out)


def near_rows(postings: DataFrame) -> DataFrame:
    """What near pairs compare: normalised title, company and beginning of the description."""
    return postings.select("doc_id", normal_text(F.col("title")).alias("t"), normal_text(F.col("company")).alias("c"), normal_text(F.substring(F.col("description"), 1, 500)).alias("d"))


def collapsed(postings: DataFrame) -> DataFrame:
    """One row for each distinct comparison of postings with its least id and how many it stands for: exact repeats need no comparing, near_with_members says whose repeats they are."""
    return near_rows(postings).groupBy("t", "c", "d").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def near_pairs(postings: DataFrame, least: float = 0.9) -> DataFrame:
    """(doc_id, other_id, similarity) of distinct postings in a bucket of three letters that share a title word. Lengths bound the ratio, so most pairs are dropped before Python sees them."""
    one = collapsed(postings).withColumn("bucket", F.substring("t", 1, 3)).where("t != ''")
    a = one.select("bucket", "doc_id", "t", "c", "d")
    b = one.select("bucket", *(F.col(c).alias(f"{c}2") for c in ("doc_id", "t", "c", "d")))
    bound = lambda x, y: F.coalesce(F.try_divide(2.0 * F.least(F.length(x), F.length(y)), F.length(x) + F.length(y)), F.lit(1.0))
    pairs = a.join(b, "bucket").where((F.col("doc_id") < F.col("doc_id2")) & F.arrays_overlap(F.split("t", " "), F.split("t2", " ")) & (bound(F.col("t"), F.col("t2")) * 0.5 + bound(F.col("c"), F.col("c2")) * 0.3 + 0.2 >= least))
    described = F.when((F.col("d") == "") & (F.col("d2") == ""), 1.0).when((F.col("d") != "") & (F.col("d2") != "") & F.arrays_overlap(F.split("d", " "), F.split("d2", " ")), ratio("d", "d2")).otherwise(0.0)
    return pairs.select("doc_id", F.col("doc_id2").alias("other_id"), (ratio("t", "t2") * 0.5 + ratio("c", "c2") * 0.3 + described * 0.2).alias("similarity")).where(F.col("similarity") >= least)


def with_members(rows: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """(doc_id, representative, other_id, similarity): a row for each of the rows, with the least id of those whose keys are the same (other_id and similarity are null), and a row for each pair of representatives."""
    least = rows.groupBy(*(F.col(k).alias(f"{k}_") for k in keys)).agg(F.min("doc_id").alias("representative"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    members = rows.join(least, same).select("doc_id", "representative", F.lit(None).cast("long").alias("other_id"), F.lit(None).cast("double").alias("similarity"))
    return members.unionByName(pairs.select("doc_id", F.col("doc_id").alias("representative"), "other_id", "similarity"))


def near_with_members(postings: DataFrame, least: float = 0.9) -> DataFrame:
    """near_pairs, and each posting with its representative."""
    return with_members(near_rows(postings), ["t", "c", "d"], near_pairs(postings, least))


FUZZY_KEYS = ["source", "l", "c"]


def fuzzy_rows(postings: DataFrame) -> DataFrame:
    """What fuzzy pairs compare: the title in lower case and in standard form, and the company in standard form."""
    return postings.select("doc_id", "source", F.lower(F.col("title")).alias("l"), standard_title(F.col("title")).alias("t"), standard_company(F.col("company")).alias("c"))


def names(postings: DataFrame) -> DataFrame:
    """(id, l, t, c, held): distinct titles and companies as fuzzy pairs compare them, with the least id of all and, in held, of each source. Postings' texts are read here only."""
    one = postings.select("doc_id", "source", F.lower(F.col("title")).alias("l"), standard_company(F.col("company")).alias("c")).where("l IS NOT NULL").groupBy(*FUZZY_KEYS).agg(F.min("doc_id").alias("doc_id"))
    some = one.groupBy("l", "c").agg(F.min("doc_id").alias("id"), F.collect_list(F.struct("source", "doc_id")).alias("held"))
    return staged(some.withColumn("t", standard_title(F.col("l"))), "names").where("t != ''")


def met_names(some: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs of names (columns of ``names``, the other's end in 2; sc), each once, that have postings at different sources, where one title holds the first twenty letters of the other's standard form, if that has five letters or more, and the companies' ratio is at least ``least``.

    They meet on pieces of 20, 10 or 5 letters (the longest that the beginning fills, at any place of the other title) and on the company, so titles that begin alike meet only where their companies are alike. Companies are compared once, those that meet on a piece. Keys of many names are cut into blocks, each pair of which is a group of its own."""
    start = lambda t: F.substring(t, 1, 20)
    size = F.when(F.length("t") >= 20, 20).when(F.length("t") >= 10, 10).otherwise(5)
    starts = some.where(F.length("t") >= 5).withColumn("piece", F.xxhash64(F.substring("t", F.lit(1), size)))
    pieces = lambda n: F.when(F.length("l") >= n, F.transform(F.sequence(F.lit(1), F.length("l") - n + 1), lambda i: F.xxhash64(F.substring(F.col("l"), i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))
    every = some.select(F.explode(F.array_distinct(F.concat(*map(pieces, (5, 10, 20))))).alias("piece"), F.col("id").alias("id2"))
    other = some.toDF(*(f"{x}2" for x in some.columns))
    # few pieces begin a title: names go on with those only
    holding = staged(every.join(starts.select("piece"), "piece", "left_semi").join(other, "id2"), "holding")
    bound = F.coalesce(F.try_divide(2.0 * F.least(F.length("c"), F.length("c2")), F.length("c") + F.length("c2")), F.lit(1.0))
    meeting = staged(starts.select("piece", "c").distinct().join(holding.select("piece", "c2").distinct(), "piece").where(bound >= least - EPS), "companies")
    scored = staged(meeting.select("c", "c2").distinct().select("c", "c2", indel("c", "c2").alias("sc")), "company-ratios").where(F.col("sc") >= least - EPS)
    beginning = starts.join(meeting.join(scored, ["c", "c2"]), ["piece", "c"])
    key = ["piece", "c2"]
    blocks = lambda df, k: df.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias(k))
    sizes = staged(blocks(beginning, "k").join(blocks(holding, "k2"), key), "sizes")
    part = lambda x, k: F.pmod(F.xxhash64(x), F.col(k)).cast("int")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    tasks = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: a number that isn't coalesced
    cell = [*key, "s", "s2"]
    a = beginning.join(sizes, key).select(*key, *some.columns, "sc", part("id", "k").alias("s"), upto("k2").alias("s2")).repartition(tasks, *cell)
    b = holding.join(sizes, key).select(*key, *(x for x in other.columns if x != "c2"), part("id2", "k2").alias("s2"), upto("k").alias("s")).repartition(tasks, *cell)
    # a pair that meets both ways is taken from the smaller id's side
    back = (F.length("t2") >= 5) & F.col("l").contains(start("t2"))
    once = (F.col("id") <= F.col("id2")) | ~back
    apart = F.exists("held", lambda x: F.exists("held2", lambda y: x["source"] != y["source"]))
    return a.join(b, cell).where(F.col("l2").contains(start("t")) & once & apart).drop(*(x for x in cell if x != "c2"))


def title_matches(postings: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(doc_id, other_id, s, st, sc) of distinct postings (source, title, company; the least id of each) at different sources whose names meet: the titles' token-set ratio, their plain one where title and company hold the other's standard form (else null), and the companies', which is at least ``least``. Computed once and stored, so exact and fuzzy pairs can share it."""
    met = met_names(names(postings), least, block)
    # a company's standard form has what its own name has but for suffixes, so holding it is holding the form
    held = (F.col("c") != "") & (F.col("c2") != "") & (F.col("l").contains(F.col("t2")) | F.col("l2").contains(F.col("t"))) & (F.col("c").contains(F.col("c2")) | F.col("c2").contains(F.col("c")))
    forms = (F.when(F.col("alike"), F.col(x)) for x in ("t", "t2"))
    rated = met.withColumn("alike", held).select("id", "id2", "held", "held2", "alike", "sc", token_set("t", "t2").alias("s"), indel(*forms).alias("st"))
    each = staged(rated, "name-ratios").withColumn("x", F.explode("held")).withColumn("y", F.explode("held2"))
    pairs = each.where((F.col("x.source") != F.col("y.source")) & ((F.col("id") != F.col("id2")) | (F.col("x.doc_id") < F.col("y.doc_id"))))
    return pairs.select(F.least("x.doc_id", "y.doc_id").alias("doc_id"), F.greatest("x.doc_id", "y.doc_id").alias("other_id"), "s", F.when(F.col("alike"), F.col("st")).alias("st"), "sc")


#: What fuzzy pairs take of the titles' and of the companies' ratio.
SHARES = 0.7, 0.3


def fuzzy_least(least: float) -> float:
    """The companies' ratio without which no titles reach ``least``."""
    return (least - SHARES[0]) / SHARES[1]


def fuzzy_of(matches: DataFrame, least: float = 0.85) -> DataFrame:
    """The fuzzy pairs of title_matches."""
    return matches.select("doc_id", "other_id", (F.col("s") * SHARES[0] + F.col("sc") * SHARES[1]).alias("similarity")).where(F.col("similarity") >= least)


def fuzzy_pairs(postings: DataFrame, least: float = 0.85) -> DataFrame:
    """(doc_id, other_id, similarity) of distinct postings (source, title, company; the least id of each) at different sources, of which one title holds the beginning of the other: 0.7 of the titles' token-set and 0.3 of the companies' plain ratio."""
    return fuzzy_of(title_matches(postings, fuzzy_least(least)), least)


def fuzzy_with_members(postings: DataFrame, least: float = 0.85) -> DataFrame:
    """fuzzy_pairs, and each posting with its representative."""
    return with_members(fuzzy_rows(postings), FUZZY_KEYS, fuzzy_pairs(postings, least))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def groups_by_key(postings: DataFrame, key: Column) -> DataFrame:
    """Keys of more than one posting: how many there are, the least id and which sources. Sums instead of lists of ids, so no group is gathered."""
    return postings.groupBy(key.alias("group_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where("n > 1")


def without_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet: the incremental form."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def running_failures(runs: DataFrame) -> DataFrame:
    """For each source, its failures since the last success, by sums: the latest success and the failures after it."""
    last = runs.groupBy("source").agg(F.max(F.when(F.col("ok"), F.struct("ts", "run_id"))).alias("good"))
    after = runs.join(last, "source").where(~F.col("ok") & (F.col("good").isNull() | (F.struct("ts", "run_id") > F.col("good"))))
    return last.select("source").join(after.groupBy("source").agg(F.count("*").alias("failures")), "source", "left").select("source", F.coalesce("failures", F.lit(0)).alias("failures"))


def top_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_per(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows for each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
