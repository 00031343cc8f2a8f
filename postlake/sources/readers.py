"""Landed files of job boards as raw postings: JSON, RSS and HTML, one reader each, told apart by a mapping of fields."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Callable
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions.enrich import is_valid, spam_score
from postlake.functions.landing import company_and_title, first_present, place_of_tags, relative_date, remote_place, salary_in_text
from postlake.functions.text import external_id, holds, links, page_title, squeezed, text_or_empty, without_tags
from postlake.operators.dedup import first_per
from postlake.plans.criteria import Criteria

RAW = ("external_id", "source", "title", "company", "url", "description", "location", "salary", "posted_at")


def raw(df: DataFrame, source: str, fields: dict[str, Column | str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Nine text columns of df, and those to keep; those without a rule are empty, and the id is hashed from url or title if it has none."""
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    out = df.select(*(F.coalesce(col(fields[c]), F.lit("")).alias(c) if c in fields else F.lit("").alias(c) for c in RAW if c not in ("source", "posted_at")), (col(fields["posted_at"]) if "posted_at" in fields else F.lit(None).cast("string")).alias("posted_at"), *keep).withColumn("source", F.lit(source))
    own = F.when(F.col("external_id") != "", F.concat_ws("-", F.lit(source), F.col("external_id"))).otherwise(external_id(F.col("source"), F.col("url"), F.col("title")))
    return out.withColumn("external_id", own).select(*RAW, *keep)


#: Boards that land JSON: the list of records in a file, its schema, and the rule for each field.
JSON_BOARDS = {
    "remotive": ("jobs", "array<struct<id:long,title:string,company_name:string,url:string,description:string,candidate_required_location:string,salary:string,publication_date:string>>", {"external_id": "id", "title": "title", "company": "company_name", "url": "url", "description": "description", "location": "candidate_required_location", "salary": "salary", "posted_at": "publication_date"}),
    "arbeitnow": ("data", "array<struct<slug:string,title:string,company_name:string,url:string,description:string,location:string,tags:array<string>,created_at:long>>", {"external_id": "slug", "title": "title", "company": "company_name", "url": "url", "description": "description", "location": "location", "posted_at": "created_at"}),
    "adzuna": ("results", "array<struct<id:string,title:string,company:struct<display_name:string>,redirect_url:string,description:string,location:struct<display_name:string>,salary_min:double,salary_max:double,created:string>>", {"external_id": "id", "title": "title", "company": "company.display_name", "url": "redirect_url", "description": "description", "location": "location.display_name", "posted_at": "created"}),
    "greenhouse": ("jobs", "array<struct<id:long,title:string,absolute_url:string,content:string,location:struct<name:string>,updated_at:string>>", {"external_id": "id", "title": "title", "url": "absolute_url", "description": "content", "location": "location.name", "posted_at": "updated_at"}),
    "jobicy": ("jobs", "array<struct<id:long,jobTitle:string,companyName:string,url:string,jobDescription:string,jobGeo:string,pubDate:string>>", {"external_id": "id", "title": "jobTitle", "company": "companyName", "url": "url", "description": "jobDescription", "location": "jobGeo", "posted_at": "pubDate"}),
    "himalayas": ("jobs", "array<struct<guid:string,title:string,companyName:string,applicationLink:string,description:string,locationRestrictions:array<string>,minSalary:long,maxSalary:long,pubDate:long>>", {"external_id": "guid", "title": "title", "company": "companyName", "url": "applicationLink", "description": "description", "posted_at": "pubDate"}),
}


def salary_text(low: Column, high: Column, currency: str = "$") -> Column:
    """A range as text from two numbers."""
    return F.when(low.isNotNull() & high.isNotNull(), F.format_string(f"{currency}%d - {currency}%d/yr", low.cast("long"), high.cast("long"))).when(low.isNotNull(), F.format_string(f"{currency}%d+/yr", low.cast("long"))).otherwise("")


def read_json(spark: SparkSession, path: str, board: str) -> DataFrame:
    """Landed answers of a board, one JSON document a file, with a declared schema."""
    top, kind, fields = JSON_BOARDS[board]
    rows = spark.read.schema(f"`{top}` {kind}").json(path, multiLine=True).select(F.explode(top).alias("r")).select("r.*")
    fields = dict(fields)
    if board == "adzuna":
        fields["salary"] = salary_text(F.col("salary_min"), F.col("salary_max"))
    if board == "himalayas":
        fields |= {"salary": salary_text(F.col("minSalary"), F.col("maxSalary")), "location": F.array_join("locationRestrictions", ", ")}
    if board == "arbeitnow":
        fields["description"] = F.concat_ws(" ", "description", F.array_join("tags", " "))
    return raw(rows, board, fields)


ITEM = "title string, link string, description string, pubDate string, guid string, category array<string>"


def read_rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Items of landed RSS files."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    named = company_and_title(squeezed(F.col("title")))
    text = without_tags(F.col("description"))
    return raw(items, source, {"external_id": "guid", "title": named["title"], "company": named["company"], "url": "link", "description": text, "location": place_of_tags(F.col("category")), "salary": salary_in_text(text), "posted_at": "pubDate"})


def read_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Landed HTML pages, one a file."""
    pages = spark.read.text(path, wholetext=True).withColumn("url", F.input_file_name())
    return raw(pages, source, {"title": page_title(F.col("value")), "url": "url", "description": without_tags(F.col("value"))})


def read_comments(df: DataFrame, source: str, body: str = "body") -> DataFrame:
    """Lines of the form "Company | Title | Place" in comments."""
    line = df.select(F.explode(F.split(body, "\n")).alias("line")).where(F.col("line").rlike(r"^[^|]+\|[^|]+"))
    part = lambda i: F.trim(F.coalesce(F.try_element_at(F.split("line", r"\s*\|\s*"), F.lit(i)), F.lit("")))
    return raw(line, source, {"title": part(2), "company": part(1), "location": part(3), "description": "line"})


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.select("page_id", F.explode(F.array_distinct(links(F.col(html)))).alias("link"))


def backfilled(postings: DataFrame, pages: DataFrame, least: int = 100) -> DataFrame:
    """postings with the text of the landed page of their url where their own description is shorter than ``least`` and the host isn't one of those whose pages aren't read."""
    texts = pages.groupBy("url").agg(F.max(without_tags(F.col("html"))).alias("_page"))
    short = (F.length(F.coalesce("description", F.lit(""))) < least) & ~holds(text_or_empty(F.col("url")), D.BLOCKED_HOSTS)
    return postings.join(texts, "url", "left").withColumn("description", F.when(short & F.col("_page").isNotNull(), F.col("_page")).otherwise(F.col("description"))).drop("_page")


def read_fan_out(spark: SparkSession, folder: str, board: str) -> DataFrame:
    """A board that has one file for each company's slug (slug.json): all of them, with the source "board:slug" and the slug as company where the record names none."""
    top, kind, fields = JSON_BOARDS[board]
    slug = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = spark.read.schema(f"`{top}` {kind}").json(f"{folder}/*.json", multiLine=True).withColumn("slug", slug).select("slug", F.explode(top).alias("r")).select("slug", "r.*")
    out = raw(rows, board, {**fields, "company": fields.get("company", "slug"), "location": fields["location"]}, keep=["slug"])
    return out.withColumn("source", F.concat_ws(":", F.lit(board), F.col("slug"))).drop("slug")


def read_graphql(spark: SparkSession, path: str, source: str, nodes: str, record: str, keys: dict[str, list[str]]) -> DataFrame:
    """Landed answers of a GraphQL endpoint: the list at the dotted path ``nodes`` with records of the schema ``record``; each field is the first of its keys that has a value."""
    schema = f"array<struct<{record}>>"
    for name in reversed(nodes.split(".")):
        schema = f"struct<`{name}`:{schema}>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j")).select(F.explode(F.col("j." + nodes)).alias("r"))
    return raw(rows.select("r.*"), source, {c: first_present(*map(F.col, names)) for c, names in keys.items()})


def read_cards(spark: SparkSession, path: str, source: str, card: str, fields: dict[str, str]) -> DataFrame:
    """Cards in landed HTML pages: each match of ``card`` is a record, each field the first group of its pattern without tags. Places are marked as remote, relative dates stay text."""
    cards = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(card), F.lit(0))).alias("card"))
    found = {c: without_tags(F.regexp_extract("card", p, 1)) for c, p in fields.items()}
    found["location"] = remote_place(found.get("location", F.lit("")))
    found["posted_at"] = first_present(found.get("posted_at", F.lit("")), relative_date(without_tags(F.col("card"))))
    return raw(cards, source, found).where("title != '' AND url != ''")


def read_cvs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of CV files: plain text, and Word files by their document part; of other kinds the text is null."""

    @F.pandas_udf("string")
    def texts(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([file_text(p, c) for p, c in zip(paths, contents, strict=True)], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", texts("path", "content").alias("text"))


def file_text(path: str, content: bytes) -> str | None:
    if path.lower().endswith(".txt"):
        return content.decode("utf-8", "replace")
    if path.lower().endswith(".docx"):
        with zipfile.ZipFile(io.BytesIO(content)) as parts:
            root = ElementTree.fromstring(parts.read("word/document.xml"))
        name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        return "\n".join("".join(t.text or "" for t in p.iter(f"{name}t")) for p in root.iter(f"{name}p"))
    return None


#: Readers by the name of their source: (spark, folder) to raw postings; a source's files are in the folder's part of that name.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, folder, n=name: read_json(spark, f"{folder}/{n}/*.json", n)) for name in JSON_BOARDS}


def read_sources(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """The chosen sources' postings (all, if none are named), each external id once: that of the first source. Unknown names are warned of and left out."""
    chosen = list(READERS) if not names else [n for n in names if n in READERS]
    for name in set(names or ()) - set(READERS):
        warnings.warn(f"unknown source: {name}", stacklevel=2)
    if not chosen:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in RAW))
    frames = [READERS[n](spark, folder).withColumn("_order", F.lit(i)) for i, n in enumerate(chosen)]
    return first_per(reduce(DataFrame.unionByName, frames), ["external_id"], F.col("_order"), F.col("url"), F.col("title")).drop("_order")


def source_parameters(q: Criteria) -> dict:
    """What of a search a source can apply itself."""
    told = {"query": q.query, "remote": q.remote_only or None, "experience_min": q.min_experience, "experience_max": q.max_experience, "posted_within_days": q.posted_within_days}
    return {k: v for k, v in told.items() if v not in (None, "", 0) or (k.startswith("experience") and v == 0)}


def ingested(rows: DataFrame, most_spam: float = 0.5) -> DataFrame:
    """Raw postings with spam_score and outcome: invalid without title, company or url, spam above ``most_spam``, else kept."""
    t, d = F.col("title"), F.col("description")
    out = rows.withColumn("spam_score", spam_score(t, d))
    return out.withColumn("outcome", F.when(~is_valid(t, F.col("company"), F.col("url")), "invalid").when(F.col("spam_score") > most_spam, "spam").otherwise("kept"))


def observed(rows: DataFrame, name: str | Observation = "ingest") -> DataFrame:
    """rows with counts of their outcomes as metrics of the job that reads them, so nothing is read twice for them."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return rows.observe(name, F.count(F.lit(1)).alias("fetched"), count("invalid"), count("spam"), count("kept"))
