"""Clusters of postings that stand for one job: exact, fuzzy and semantic matches in turn, clusters with a primary, and their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions.text import cluster_md5, standard_company, standard_title
from postlake.operators.dedup import title_matches
from postlake.operators.neardup import greedy
from postlake.operators.staging import staged


def cluster_key(title: Column, company: Column) -> Column:
    return F.replace(F.concat_ws("|", standard_title(title), standard_company(company)), F.lit(" "), F.lit("_"))


def exact_of(matches: DataFrame, least: float = 0.85) -> DataFrame:
    """The exact pairs of dedup.title_matches."""
    return matches.where((F.col("st") >= least) & (F.col("sc") >= least)).select("doc_id", "other_id", ((F.col("st") + F.col("sc")) / 2).alias("similarity"))


def exact_pairs(postings: DataFrame, least: float = 0.85) -> DataFrame:
    """(doc_id, other_id, similarity) of distinct postings (source, title, company; the least id of each) at different sources, where title and company hold the other's standard form and both forms are alike. Titles meet as for fuzzy pairs."""
    return exact_of(title_matches(postings, least), least)


def cascade(exact: DataFrame, fuzzy: DataFrame, semantic: DataFrame) -> DataFrame:
    """(doc_id, other_id, similarity, kind): matches of each posting at the first of three levels that has any for it."""
    both = lambda p, kind: p.select("doc_id", "other_id", "similarity").unionByName(p.select(F.col("other_id").alias("doc_id"), F.col("doc_id").alias("other_id"), "similarity")).withColumn("kind", F.lit(kind))
    out = None
    for pairs, kind in ((exact, "exact"), (fuzzy, "fuzzy"), (semantic, "semantic")):
        level = both(pairs, kind)
        out = level if out is None else out.unionByName(level.join(out.select("doc_id").distinct(), "doc_id", "left_anti"))
    return out


def edges(exact: DataFrame, fuzzy: DataFrame, semantic: DataFrame) -> DataFrame:
    """(a, b, similarity, kind) of pairs of postings, a < b: each pair once, at the first of the three levels that finds it."""
    level = lambda p, i, kind: p.select("doc_id", "other_id", F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), "similarity").alias("x"))
    found = level(exact, 1, "exact").unionByName(level(fuzzy, 2, "fuzzy")).unionByName(level(semantic, 3, "semantic"))
    ends = found.select(F.least("doc_id", "other_id").alias("a"), F.greatest("doc_id", "other_id").alias("b"), "x").where("a < b")
    return ends.groupBy("a", "b").agg(F.min("x").alias("x")).select("a", "b", "x.similarity", "x.kind")


def stars(pairs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Star clusters of the ends of pairs (a, b, similarity, kind): in the order of ids a posting that no earlier seed matches is a seed, and what matches it is its cluster. Not transitive: a member brings nothing in, and may belong to several seeds.

    Returns states (id, kept: whether it is a seed) and members (seed, doc_id, similarity, kind). ``known`` are the states of earlier calls; then pairs have all new ids, with each other and with known ones, and what is returned is new: added to the earlier tables it is what one call over all pairs returns. New ids must be greater than known ones, so that what was decided stays."""
    written = staged(pairs, "pairs")
    states = staged(greedy(written, known), "states")
    seeds = states if known is None else states.unionByName(known.select("id", "kept"))
    seeds = seeds.where("kept").select(F.col("id").alias("seed"))
    ends = written.select(F.col("a").alias("seed"), F.col("b").alias("doc_id"), "similarity", "kind").unionByName(written.select(F.col("b").alias("seed"), F.col("a").alias("doc_id"), "similarity", "kind"))
    return states, ends.join(seeds, "seed")


def starred(members: DataFrame, postings: DataFrame) -> DataFrame:
    """(seed, primary_id, size, duplicate_count) of star clusters; the primary is of the source with the highest priority, then the least id."""
    rank = postings.select("doc_id", priority(F.col("source")).alias("p"))
    each = members.select("seed", "doc_id").unionByName(members.select("seed", F.col("seed").alias("doc_id")).distinct()).join(rank, "doc_id")
    return each.groupBy("seed").agg(F.max_by("doc_id", F.struct("p", -F.col("doc_id"))).alias("primary_id"), F.count("*").alias("size")).withColumn("duplicate_count", F.col("size") - 1)


def priority(source: Column) -> Column:
    out = F.lit(0)
    for name, n in D.CLUSTER_PRIORITY.items():
        out = F.when(source == name, n).otherwise(out)
    return out


def with_cluster(postings: DataFrame) -> DataFrame:
    return postings.withColumn("cluster_hash", cluster_md5(F.col("title"), F.col("company"), F.col("location")))


def built(postings: DataFrame) -> DataFrame:
    """(cluster_hash, primary_id, size, duplicate_count) of clusters of several postings; the primary is of the source with the highest priority, then the least id."""
    rows = with_cluster(postings).select("cluster_hash", "doc_id", priority(F.col("source")).alias("p"))
    best = F.max_by("doc_id", F.struct("p", -F.col("doc_id"))).alias("primary_id")
    return rows.groupBy("cluster_hash").agg(best, F.count("*").alias("size")).where("size > 1").withColumn("duplicate_count", F.col("size") - 1)


def members(postings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_hash, doc_id) of what a cluster has beside its primary."""
    return with_cluster(postings).select("cluster_hash", "doc_id").join(clusters.select("cluster_hash", "primary_id"), "cluster_hash").where("doc_id != primary_id").drop("primary_id")


def analysis(clusters: DataFrame, member: DataFrame, jobs: DataFrame, scoring: DataFrame) -> DataFrame:
    """Of each cluster how many postings it has, the best score and the sources of its members, by left joins, so clusters without members or scores stay."""
    joined = clusters.join(member, "cluster_hash", "left").join(jobs.select("doc_id", "source"), "doc_id", "left").join(scoring.select("doc_id", "final_score"), "doc_id", "left")
    return joined.groupBy("cluster_hash").agg((F.count("doc_id") + 1).alias("total_duplicates"), F.max("final_score").alias("best_score"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("source_list"))


def summary(clusters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Clusters with the title, company and source of their primary."""
    return clusters.join(jobs.select(F.col("doc_id").alias("primary_id"), "title", "company", "source"), "primary_id").select("cluster_hash", "duplicate_count", "title", "company", "source")
