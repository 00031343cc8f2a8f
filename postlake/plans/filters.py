"""The filter cascade: one expression that names the first rule a posting fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions import classify as C
from postlake.functions.numbers import experience_ranges
from postlake.functions.tagging import Tagged, columns, fields, tagged, untagged
from postlake.functions.text import hits, joined, text_or_empty
from postlake.plans.criteria import Criteria


def term_count(c: Column, terms: list[str]) -> Column:
    low = c if isinstance(c, Tagged) else F.lower(text_or_empty(c))
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0))


def matches_query(title: Column, description: Column, q: Criteria) -> Column:
    needed = max(1, max(1, min(2, len(q.terms))) - 1)
    same_role = F.coalesce(C.role_category(title, description) == F.lit(q.role), F.lit(False)) if q.role else F.lit(False)
    loose = (term_count(joined(title, description), q.terms) >= needed) | C.is_relevant_role(title, description)
    return (term_count(title, q.terms) >= 1) | same_role | (F.lit(False) if q.strict_title else loose)


def matches_experience(c: Column, q: Criteria) -> Column:
    if q.min_experience is None and q.max_experience is None:
        return F.lit(True)
    low, high = q.min_experience or 0, 99 if q.max_experience is None else q.max_experience
    found = experience_ranges(c)
    return F.when(F.size(found) == 0, F.lit(not q.strict_experience)).otherwise(F.exists(found, lambda r: (r["low"] <= high) & (F.coalesce(r["high"], F.lit(99)) >= low)))


def posted_within(posted: Column, q: Criteria) -> Column:
    if not q.posted_within_days:
        return F.lit(True)
    return F.coalesce(posted >= F.lit(q.as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(q.posted_within_days)), F.lit(True))


def reject_reason(q: Criteria, texts: dict[str, Column | Tagged] | None = None) -> Column:
    """The first rule that title, company, description, location and posted_at fail; null if none. texts: those four, tagged or not."""
    texts = texts or columns()
    title, company, text, place = (texts[c] for c in ("title", "company", "description", "location"))
    whole = joined(title, text, place)
    rules = [(C.likely_fake(title, text, company), "fake"), (~matches_query(title, text, q), "query")]
    if q.strict_junior:
        rules.append((~C.is_junior(title, text), "not junior"))
    rules.append((~matches_experience(whole, q), "experience"))
    if q.max_experience is not None and q.max_experience <= 2:
        rules.append((hits(whole, D.SENIOR), "senior"))
    if q.remote_only:
        rules.append((~(C.globally_remote(place, text) | hits(whole, [r"\bremote\b"]) | (text_or_empty(place) == "")), "not remote"))
    if q.global_or_india:
        rules.append(((C.region(place, text) == "Unknown") & ~hits(joined(place, text), [r"\bremote\b"]), "region"))
    if q.exclude_indian:
        rules += [(~C.outside_india(company), "company"), (C.in_india(place, text), "place")]
    rules.append((~posted_within(F.col("posted_at"), q), "too old"))
    return C.first_of(rules)


def passing(postings: DataFrame, q: Criteria) -> DataFrame:
    """postings that no rule rejects, with their tags if they come with them."""
    rows = tagged(postings)
    kept = rows.where(reject_reason(q, fields()).isNull())
    return kept if rows is postings else untagged(kept)
