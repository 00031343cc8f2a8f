"""Relevance of postings to criteria: seven parts as expressions, weighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions import classify as C
from postlake.functions.numbers import days_between
from postlake.functions.tagging import Tagged, columns, fields, tagged, untagged
from postlake.functions.text import holds, joined, low_of, text_or_empty
from postlake.plans.criteria import Criteria
from postlake.plans.filters import term_count


Texts = dict[str, Column | Tagged]


def title_score(q: Criteria, texts: Texts) -> Column:
    title, text = texts["title"], texts["description"]
    low = low_of(title)
    if not q.query or not q.terms:
        return F.when(low == q.query.lower(), 1.0).otherwise(F.lit(0.5)) if q.query else F.lit(0.5)
    share = term_count(title, q.terms) / F.lit(float(len(q.terms)))
    role = F.coalesce(C.role_category(title, text) == F.lit(q.role), F.lit(False)) if q.role else F.lit(False)
    fallback = F.lit(0.0) if q.strict_title else F.when(C.is_relevant_role(title, text), 0.4).otherwise(0.0)
    return F.when(low == q.query.lower(), 1.0).when(share == 1, 1.0).when(share > 0, share * (0.5 if q.strict_title else 1.0)).when(role, 0.8).otherwise(fallback)


def description_score(q: Criteria, texts: Texts) -> Column:
    if not q.terms:
        return F.lit(0.5)
    share = term_count(joined(texts["title"], texts["description"]), q.terms) / F.lit(float(len(q.terms)))
    return F.when(text_or_empty(F.col("description")) == "", 0.5).when(share == 0, 0.0).otherwise(share if q.strict_title else F.least(F.lit(1.0), share + 0.2))


def experience_score(q: Criteria) -> Column:
    if q.min_experience is None and q.max_experience is None:
        return F.lit(1.0)
    zero_as = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(other))  # noqa: E731  0 counts as missing
    low, high = zero_as("experience_min", 0), zero_as("experience_max", 99)
    least, most = q.min_experience or 0, q.max_experience or 99
    overlap = F.least(high, F.lit(most)) - F.greatest(low, F.lit(least))
    own = F.when(high != low, high - low).otherwise(1)
    part = overlap / F.greatest(own, F.lit(most - least if most != least else 1))
    apart = F.lit(0.0) if q.strict_experience else F.when((low <= most + 1) & (high >= least - 1), 0.3).otherwise(0.0)
    return F.when((low <= most) & (high >= least), F.when((low >= least) & (high <= most), 1.0).otherwise(F.least(F.lit(1.0), part + 0.3))).otherwise(apart)


def seniority_score(q: Criteria) -> Column:
    if not q.seniority_levels:
        return F.lit(1.0)
    step = F.lit(2)
    for name, n in D.SENIORITY_STEPS.items():
        step = F.when(F.col("seniority") == name, n).otherwise(step)
    near = F.least(*(F.abs(step - D.SENIORITY_STEPS.get(s, 2)) for s in q.seniority_levels), F.lit(99))
    return F.when(F.col("seniority") == "unknown", 0.5).when(F.col("seniority").isin(*q.seniority_levels) | (near == 0), 1.0).when(near == 1, 0.7).when(near == 2, 0.4).otherwise(0.1)


def location_score(q: Criteria, texts: Texts) -> Column:
    if not q.remote_only:
        return F.lit(1.0)
    both = joined(texts["location"], texts["description"])
    by_text = F.when(holds(both, ["remote", "worldwide", "anywhere", "global"]), 0.8).when(holds(both, ["onsite", "on-site", "in office", "hybrid"]), 0.3).otherwise(0.5)
    return F.when(F.col("remote_type") == "fully_remote", 1.0).when(F.col("remote_type") == "hybrid", 0.5).when(F.col("remote_type") == "onsite", 0.0).otherwise(by_text)


def freshness_score(q: Criteria) -> Column:
    if not q.posted_within_days:
        return F.lit(1.0)
    age, most = days_between(F.lit(q.as_of).cast("timestamp_ntz"), F.col("posted_at")), q.posted_within_days
    return F.when(F.col("posted_at").isNull() | (age <= 0), 1.0).when(age <= most, 1.0 - age / F.lit(float(most)) * 0.5).when(age <= 2 * most, 0.3).otherwise(0.0)


def quality_score() -> Column:
    size = F.length(text_or_empty(F.col("description")))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    low, high = F.col("salary_min"), F.col("salary_max")
    parts = [
        F.when(size >= 500, 0.20).when(size >= 200, 0.15).when(size >= 100, 0.10).when(size >= 50, 0.05).otherwise(0.0),
        F.when(low.isNotNull() & high.isNotNull(), F.when(high > low, 0.25).otherwise(0.15)).when(low.isNotNull() | high.isNotNull(), 0.10).otherwise(0.0),
        F.when(count("skills") >= 3, 0.20).when(count("skills") >= 1, 0.12).when(count("tags") >= 1, 0.05).otherwise(0.0),
        F.when(count("requirements") >= 2, 0.10).when(count("requirements") == 1, 0.05).otherwise(0.0),
        F.when(count("responsibilities") >= 2, 0.10).when(count("responsibilities") == 1, 0.05).otherwise(0.0),
        F.when(F.trim(text_or_empty(F.col("location"))) != "", 0.05).otherwise(0.0),
        F.when(F.col("seniority") != "unknown", 0.05).otherwise(0.0),
    ]
    return F.round(F.least(F.lit(1.0), sum(parts[1:], parts[0])), 2)


def parts(q: Criteria, texts: Texts | None = None) -> dict[str, Column]:
    texts = texts or columns()
    return {"title": title_score(q, texts), "description": description_score(q, texts), "experience": experience_score(q), "seniority": seniority_score(q), "location": location_score(q, texts), "freshness": freshness_score(q), "quality": quality_score()}


def relevance(postings: DataFrame, q: Criteria) -> DataFrame:
    """postings with s_* for each part and relevance_score."""
    rows = tagged(postings)
    scored = rows.withColumns({f"s_{k}": v.cast("double") for k, v in parts(q, fields()).items()})
    scored = scored if rows is postings else untagged(scored)
    total = sum((F.col(f"s_{k}") * w for k, w in D.RELEVANCE_WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("relevance_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3))


def most_relevant(postings: DataFrame, q: Criteria, least: float = 0.5, limit: int | None = None) -> DataFrame:
    out = relevance(postings, q).where(F.col("relevance_score") >= least).orderBy(F.desc("relevance_score"), "doc_id")
    return out.limit(limit) if limit else out
