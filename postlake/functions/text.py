"""Text rules as Column expressions: no Python runs for a row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions.tagging import Tagged


def text_or_empty(c: Column | Tagged) -> Column:
    return c.raw if isinstance(c, Tagged) else F.coalesce(c, F.lit(""))


def low_of(c: Column | Tagged) -> Column:
    return c.low if isinstance(c, Tagged) else F.lower(text_or_empty(c))


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def words_pattern(words: list[str]) -> str:
    return r"\b" + any_of([re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words]) + r"\b"


def has_words(c: Column | Tagged, words: list[str]) -> Column:
    """Whether any of the words or phrases occurs between word boundaries, without case."""
    return c.has(words) if isinstance(c, Tagged) else F.lower(text_or_empty(c)).rlike(words_pattern(words))


def hits(c: Column | Tagged, patterns: list[str]) -> Column:
    """Whether any pattern is found, without case."""
    return c.hits(patterns) if isinstance(c, Tagged) else F.lower(c).rlike(any_of(patterns))


def holds(c: Column | Tagged, phrases: list[str]) -> Column:
    """Whether any phrase is a substring."""
    if isinstance(c, Tagged):
        return c.holds(phrases)
    return F.greatest(*(F.lower(c).contains(p) for p in phrases), F.lit(False))


def joined(*cs: Column | Tagged) -> Column | Tagged:
    if all(isinstance(c, Tagged) for c in cs):
        return Tagged("".join(c.parts for c in cs))
    return F.concat_ws(" ", *(text_or_empty(c) for c in cs))


def normal_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9\s]", ""), r"\s+", " "))


def normal_url(c: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_replace(text_or_empty(c), r"[?#].*$", ""), F.lit("/")))


def signature(title: Column, company: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", normal_text(title), normal_text(company), normal_url(url)), 256), 1, 16)


def near_id(a: Column, b: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", a, b), 256), 1, 16)


def title_company_md5(title: Column, company: Column) -> Column:
    bare = lambda c: F.trim(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}_\s]", ""))
    return F.md5(F.concat_ws("|", bare(title), bare(company)))


def legacy_signature(title: Column, company: Column, description: Column) -> Column:
    """The form that older records carry: the description is cut before its marks are dropped."""
    bare = lambda c: F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]", "")
    return F.substring(F.sha2(F.concat_ws("|", bare(title), bare(company), bare(F.substring(description, 1, 200))), 256), 1, 16)


def title_tokens(c: Column) -> Column:
    return F.array_distinct(F.split(standard_title(c), " "))


def expanded_query(query: str, most: int = 3) -> str:
    """The query and up to so many single words of the first role that one of its words or phrases tells."""
    low = query.lower()
    for words in D.ROLES.values():
        if any(w in low for w in words):
            new = [w for w in dict.fromkeys(words) if " " not in w and w not in low.split()][:most]
            if new:
                return " ".join([query, *new])
    return query


def external_id(source: Column, url: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit(":"), F.coalesce(F.when(url != "", url), title, F.lit(""))), 256), 1, 32)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def standard_title(c: Column) -> Column:
    out = F.trim(F.lower(text_or_empty(c)))
    for short, long in D.TITLE_FORMS:
        out = F.replace(out, F.lit(short), F.lit(long))
    return F.array_join(F.filter(F.split(squeezed(out), " "), lambda w: ~w.isin(D.STOP_WORDS)), " ")


def standard_company(c: Column) -> Column:
    """Without legal suffixes, the longest first, each once."""
    out = F.trim(F.lower(text_or_empty(c)))
    for suffix in sorted(D.COMPANY_SUFFIXES, key=lambda s: (-len(s), s)):
        out = F.trim(F.regexp_replace(out, re.escape(suffix) + "$", ""))
    return squeezed(out)


def standard_location(c: Column) -> Column:
    out = F.trim(F.lower(text_or_empty(c)))
    for old, new in (("united states", "us"), ("united kingdom", "uk"), ("remote - ", ""), ("remote ", "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return squeezed(out)


def cluster_md5(title: Column, company: Column, location: Column) -> Column:
    return F.md5(F.concat_ws("|", standard_title(title), standard_company(company), standard_location(location)))


def without_tags(c: Column) -> Column:
    """Text of HTML: entities restored, scripts, styles and tags dropped, white space squeezed."""
    out = F.regexp_replace(text_or_empty(c), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(character))
    return squeezed(out)


def links(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"(?i)href=[\"']([^\"'#]+)"), F.lit(1))


def page_title(c: Column) -> Column:
    return squeezed(F.regexp_extract(text_or_empty(c), r"(?is)<title[^>]*>(.*?)</title>", 1))


def query_terms(query: str) -> list[str]:
    return [t for t in re.findall(r"[a-zA-Z0-9+#.]+", query.lower()) if t not in D.QUERY_STOP_WORDS]
