"""Listing of jobs: the filters that a caller can set, their order and page."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class JobFilter:
    """Each filter that is set must hold. Text filters but the levels are parts without regard to case; search looks into title, company and description."""

    is_active: bool | None = None
    is_applied: bool | None = None
    source: str | None = None
    tech_stack: str | None = None
    company_size: str | None = None
    experience_level: str | None = None
    region_eligibility: str | None = None
    is_verified_remote: bool | None = None
    seniority_tag: str | None = None
    is_duplicate: bool | None = None
    is_sponsored: bool | None = None
    is_hot_job: bool | None = None
    search: str | None = None
    offset: int = 0
    limit: int = 50

    PARTS = ("source", "tech_stack")
    EQUAL = ("is_active", "company_size", "experience_level", "region_eligibility", "is_verified_remote", "seniority_tag", "is_duplicate", "is_sponsored", "is_hot_job")
    SEARCHED = ("title", "company", "description")


#: What a request can set, by the parameter's name.
PARAMETERS = {"search": "search", "source": "source", "tech_stack": "tech_stack", "company_size": "company_size", "experience_level": "experience_level", "region": "region_eligibility", "is_applied": "is_applied", "is_active": "is_active", "offset": "offset", "limit": "limit"}


def from_request(parameters: dict) -> JobFilter:
    """The filter of a request; other parameters are ignored."""
    return JobFilter(**{PARAMETERS[k]: v for k, v in parameters.items() if k in PARAMETERS and v not in (None, "")})


def holds_part(c: str, part: str) -> Column:
    return F.coalesce(F.lower(F.col(c)).contains(part.lower()), F.lit(False))


def conditions(f: JobFilter) -> list[Column]:
    out = [F.col(c) == getattr(f, c) for c in f.EQUAL if getattr(f, c) not in (None, "")]
    out += [holds_part(c, getattr(f, c)) for c in f.PARTS if getattr(f, c)]
    if f.search:
        out.append(reduce(Column.__or__, (holds_part(c, f.search) for c in f.SEARCHED)))
    return out


def matching(jobs: DataFrame, f: JobFilter, applied: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """All jobs that the filter lets through; ``applied`` has the keys that the user applied to."""
    out = jobs.where(reduce(Column.__and__, conditions(f), F.lit(True)))
    if f.is_applied is not None and applied is not None:
        out = out.join(applied.select(key).distinct(), key, "left_semi" if f.is_applied else "left_anti")
    return out


def listed(jobs: DataFrame, f: JobFilter, applied: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One page: newest first, jobs without a date last; of equal dates what was read last, then by key."""
    rows = matching(jobs, f, applied, key)
    return rows.orderBy(F.desc_nulls_last("posted_at"), F.desc("scraped_at"), key).offset(f.offset).limit(f.limit)
