"""Fields of landed HTML pages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.landing import first_present
from postlake.functions.text import text_or_empty, without_tags

LD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
BOILERPLATE = r"(?is)<(?:script|style|nav|header|footer|aside|form|noscript)\b.*?</(?:script|style|nav|header|footer|aside|form|noscript)>"
LEAST = 100


def meta_pattern(name: str) -> str:
    return rf"(?is)<meta[^>]*(?:name|property)=[\"'](?:og:)?{name}[\"'][^>]*content=[\"']([^\"']*)"


def class_pattern(*parts: str) -> str:
    """The first text of an element one of whose classes has one of the parts."""
    return rf"(?is)<[a-z0-9]+[^>]*class=[\"'][^\"']*(?:{'|'.join(parts)})[^\"']*[\"'][^>]*>(.*?)</"


def tag_pattern(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"


def found(html: Column, pattern: str) -> Column:
    """The first match's group without tags."""
    return without_tags(F.regexp_extract(text_or_empty(html), pattern, 1))


def job_posting(html: Column) -> Column:
    """The first JSON-LD object of a page that is a job posting, as text; null if there is none."""
    objects = F.regexp_extract_all(text_or_empty(html), F.lit(LD), F.lit(1))
    return F.try_element_at(F.filter(objects, lambda j: F.get_json_object(j, "$.@type") == "JobPosting"), F.lit(1))


def job_details(html: Column) -> Column:
    """Struct (title, company, description, location, salary, posted_at, url): what a job posting object says, else meta tags, headings and elements by class."""
    ld = job_posting(html)
    at = lambda path: F.get_json_object(ld, f"$.{path}")
    place = first_present(at("jobLocation.address.addressLocality"), at("jobLocation.address.addressRegion"), at("jobLocation[0].address.addressLocality"))
    fields = {
        "title": first_present(at("title"), F.regexp_extract(text_or_empty(html), meta_pattern("title"), 1), found(html, tag_pattern("h1"))),
        "company": first_present(at("hiringOrganization.name"), found(html, class_pattern("company", "employer"))),
        "description": first_present(at("description"), F.regexp_extract(text_or_empty(html), meta_pattern("description"), 1), found(html, class_pattern("description"))),
        "location": first_present(place, found(html, class_pattern("location"))),
        "salary": first_present(at("baseSalary.value.text"), found(html, class_pattern("salary", "compensation"))),
        "posted_at": first_present(at("datePosted")),
        "url": first_present(at("url")),
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def main_text(html: Column) -> Column:
    """A page's text without navigation, forms and scripts: of its main part, article or section if that has a hundred characters, else of its body."""
    bare = F.regexp_replace(text_or_empty(html), BOILERPLATE, " ")
    texts = [found(bare, tag_pattern(t)) for t in ("main", "article", "section", "body")]
    return F.coalesce(*(F.when(F.length(t) > LEAST, t) for t in texts), F.lit(""))


def table_rows(html: Column) -> Column:
    """Array of the cells' texts of each row of the page's tables."""
    rows = F.regexp_extract_all(text_or_empty(html), F.lit(tag_pattern("tr")), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: without_tags(c)))
