"""Projections between the forms of a record: as read, normalised, and as stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions import classify as C
from postlake.functions import numbers as N
from postlake.functions import text as T
from postlake.functions.enrich import enriched_seniority
from postlake.functions.tagging import fields, tagged, untagged


def stored_of_raw(raw: DataFrame) -> DataFrame:
    """raw with what is stored: classes by words, technologies of title, text and place, and the group of its repeats."""
    t, c, d, l = (fields()[x] for x in ("title", "company", "description", "location"))
    title, company = F.col("title"), F.col("company")
    stored = tagged(raw).withColumns(
        {
            "title": F.trim(title),
            "company": F.coalesce(F.nullif(F.trim(company), F.lit("")), F.lit("Unknown")),
            "tech_stack": F.array_join(C.tech_stack(T.joined(t, d, l)), ", "),
            "company_size": C.company_size(c, d),
            "experience_level": C.experience_level(t, d),
            "region_eligibility": C.region(l, d),
            "is_verified_remote": C.verified_remote(l, d, t),
            "seniority_tag": C.seniority_tag(t, d),
            "duplicate_group_id": T.title_company_md5(title, company),
            "is_sponsored": F.lit(False),
            "is_hot_job": F.lit(False),
        }
    )
    return untagged(stored)


def normalised(raw: DataFrame) -> DataFrame:
    """raw with numbers of its salary, skills and seniority; the kinds of work and years stay unset, as the rule has it."""
    s = N.parse_salary(F.col("salary"))
    return untagged(tagged(raw).withColumns({"salary_min": s["salary_min"], "salary_max": s["salary_max"], "salary_currency": F.lit("USD"), "skills": C.tech_stack(fields()["description"]), "seniority": enriched_seniority(F.lit("unknown"), F.col("title")), "remote_type": F.lit("unknown"), "job_type": F.lit("unknown"), "experience_min_years": F.lit(None).cast("int"), "experience_max_years": F.lit(None).cast("int")}))


def stored_of_normalised(rows: DataFrame) -> DataFrame:
    """Normalised rows as stored: salary as text, skills joined, remote work checked again."""
    low, high = F.col("salary_min"), F.col("salary_max")
    pay = F.when(F.coalesce(low, F.lit(0)) != 0, F.concat(low.cast("string"), F.lit("-"), F.coalesce(high.cast("string"), F.lit("None")), F.lit(" "), F.col("salary_currency"))).otherwise("")
    f = fields()
    return untagged(tagged(rows).withColumns({"salary": pay, "tech_stack": F.when(F.size("skills") > 0, F.array_join("skills", ", ")), "experience_level": F.col("seniority"), "seniority_tag": F.col("seniority"), "is_verified_remote": C.verified_remote(f["location"], f["description"], f["title"])}))


def with_duplicates(stored: DataFrame, key: str = "doc_id", group: str = "duplicate_group_id") -> DataFrame:
    """stored with is_duplicate: whether an earlier row has its group. The first of each group comes from an aggregate, so a group of many rows isn't gathered."""
    first = stored.groupBy(group).agg(F.min(key).alias("_first"))
    return stored.join(first, group).withColumn("is_duplicate", F.col(key) != F.col("_first")).drop("_first")


def stored_with_duplicates(raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """stored_of_raw with is_duplicate. The first of each group needs titles and companies alone, so texts are read and tagged once."""
    first = raw.groupBy(T.title_company_md5(F.col("title"), F.col("company")).alias("duplicate_group_id")).agg(F.min(key).alias("_first"))
    return stored_of_raw(raw).join(first, "duplicate_group_id").withColumn("is_duplicate", F.col(key) != F.col("_first")).drop("_first")


def role_of_query(c: Column) -> Column:
    """The role that a query's words stand for: the first phrase of the list that is a part of it, inside words too."""
    low = F.lower(T.text_or_empty(c))
    return C.first_of([(low.contains(phrase), role) for phrase, role in D.QUERY_ROLES.items()])


def is_english(c: Column, language: Column | None = None) -> Column:
    """True for texts under fifty characters; else by the stated language, or by the share of common English words."""
    text = F.trim(T.text_or_empty(c))
    if language is not None:
        told = F.coalesce(language == "en", F.lit(True))
    else:
        tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))
        common = F.size(F.filter(tokens, lambda w: w.isin(*D.ENGLISH_WORDS)))
        told = common * 12 >= F.size(tokens)
    return (F.char_length(text) < 50) | told


def title_fits(title: Column, location: Column, query: str, remote_only: bool = True) -> Column:
    """Whether a board's record is worth reading further: a word of the query in its title, and a place that is remote or not said."""
    words = [w for w in query.lower().split() if w]
    some = F.greatest(*(F.lower(title).contains(w) for w in words), F.lit(False)) if words else F.lit(True)
    place = F.lower(T.text_or_empty(location))
    far = T.holds(place, ["remote", "anywhere", "worldwide", "global"]) | (place == "")
    return some & far if remote_only else some
