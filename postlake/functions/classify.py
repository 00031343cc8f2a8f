"""Classes of postings by words, as Column expressions; the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions.text import has_words, hits, holds, joined, low_of, text_or_empty


def first_of(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = F.lit(None).cast("string") if otherwise is None else F.lit(otherwise)
    for rule, name in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def role_category(title: Column, description: Column) -> Column:
    """The first category whose words are in the title, else in the description."""
    by = lambda c: first_of([(has_words(c, w), r) for r, w in D.ROLES.items()])
    return F.coalesce(by(title), by(description))


def is_relevant_role(title: Column, description: Column) -> Column:
    return has_words(joined(title, description), [w for ws in D.ROLES.values() for w in ws])


def is_junior(title: Column, description: Column) -> Column:
    both = joined(title, description)
    return ~hits(both, D.SENIOR) & (hits(both, D.JUNIOR) | hits(both, [r"\b0[\s-]?3\s*years?\b", r"\b1[\s-]?3\s*years?\b"]))


def experience_level(title: Column, description: Column) -> Column:
    both = joined(title, description)
    return first_of([(hits(both, [r"\bintern\b", r"\btrainee\b"]), "Intern"), (hits(both, D.JUNIOR), "Junior (0-2 years)"), (hits(both, D.SENIOR), "Senior (excluded)")], "Mid-level")


def seniority_tag(title: Column, description: Column) -> Column:
    both = joined(title, description)
    return first_of([(hits(both, D.SENIOR), "senior"), (hits(both, D.JUNIOR), "junior")], "mid")


def company_size(company: Column, description: Column) -> Column:
    both = joined(company, description)
    return first_of([(hits(both, D.ENTERPRISES), "Enterprise"), (hits(both, D.STARTUPS), "Startup")], "Mid-size")


def region(location: Column, description: Column) -> Column:
    both = joined(location, description)
    return first_of([(hits(both, [r"\bworldwide\b", r"\banywhere\b", r"\bglobal\b"]), "Worldwide"), (hits(both, [r"\bindia\b"]), "India Eligible"), (hits(both, [r"\bremote\b"]), "Remote (unspecified)")], "Unknown")


def verified_remote(location: Column, description: Column, title: Column) -> Column:
    both = joined(title, description, location)
    return hits(both, D.VERIFIED_REMOTE) | (~hits(both, D.NOT_REMOTE) & hits(both, [r"\bremote\b"]))


def globally_remote(location: Column, description: Column) -> Column:
    both, text = joined(location, description), joined(description)
    return (
        F.when(hits(text, D.GLOBAL_IN_TEXT) & ~hits(text, D.US_ONLY), True)
        .when(hits(both, D.REGION_ONLY), False)
        .when(hits(both, D.ON_SITE), False)
        .when(hits(both, D.REMOTE), True)
        .otherwise((F.length(text_or_empty(text)) > 100) & hits(text, D.CLOUD_TOOLS))
    )


def outside_india(company: Column) -> Column:
    """Company names by substring, so a name inside another word counts."""
    name = F.trim(low_of(company))
    return ~(holds(joined(company), D.INDIAN_COMPANIES) | name.rlike(r"\b(india|pvt\.?\s*ltd|private limited)\b"))


def in_india(location: Column, description: Column) -> Column:
    place, text, either = joined(location), joined(description), joined(location, description)
    remote = hits(text, D.REMOTE)
    city, state = (holds(place, names) | holds(text, names) for names in (D.INDIAN_CITIES, D.INDIAN_STATES))
    return city | (state & ~remote) | hits(either, [r"\bpincode\b", r"\bpin\s*code\b", r"\bindian\s+(?:time|rupees|standard|subcontinent)"]) | (hits(place, [r"\bindia\b"]) & ~remote)


def likely_fake(title: Column, description: Column, company: Column) -> Column:
    both = joined(title, description, company)
    urgent = F.when(has_words(both, ["urgent", "immediate", "asap", "today"]), F.regexp_count(low_of(both), F.lit(D.URGENT)) >= 3).otherwise(False)
    return hits(both, D.FAKE) | hits(both, D.SUSPICIOUS) | urgent | hits(both, [r"\b\d+.*\bdollar\b.*\bdaily\b"])


def tech_stack(c: Column) -> Column:
    """Names of the technologies that are mentioned, sorted."""
    found = F.array(*(F.when(hits(joined(c), patterns), F.lit(name)) for name, patterns in D.TECH.items()))
    return F.array_sort(F.array_compact(found))
