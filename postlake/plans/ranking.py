"""Trust and quality ranking: six parts from 0 to 10, a weighted sum, rank and percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions.tagging import spread
from postlake.functions.text import holds, text_or_empty
from postlake.operators.staging import staged

RANGE = 1 << 16
TEXT = ("title", "company", "url", "description", "location", "salary")


def bounded(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), c))


def source_trust(source: Column) -> Column:
    out = F.lit(D.TRUST_UNKNOWN)
    for name, value in D.TRUST.items():
        out = F.when(F.lower(source) == name, value).otherwise(out)
    return out


def freshness(posted: Column, as_of: str) -> Column:
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(posted.cast("timestamp"))) / 86400.0
    return F.when(posted.isNull(), 5.0).otherwise(10.0 * F.exp(-F.greatest(age, F.lit(0.0)) / 7.0))


def spam(title: Column, company: Column, text: Column, salary: Column) -> Column:
    both = F.concat_ws(" ", *(text_or_empty(c) for c in (title, company, text)))
    return spam_of(both, F.lower(both), title, salary)


def spam_of(both: Column, low: Column, title: Column, salary: Column) -> Column:
    """The same from the three texts joined, as they are and in lower case."""
    number = F.regexp_extract(text_or_empty(salary), r"(\d+)", 1).try_cast("decimal(30,0)")
    caps = F.filter(F.split(F.trim(text_or_empty(title)), r"\s+"), lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    words = F.size(F.filter(F.split(F.trim(text_or_empty(title)), r"\s+"), lambda w: w != ""))
    total = F.when(F.regexp_count(both, F.lit(r"[^\x00-\x7F]")) > 5, 0.3).otherwise(0.0)
    for phrase in D.SPAM_PHRASES:
        total = total + F.when(low.contains(phrase), 0.2).otherwise(0.0)
    total = total + F.when(number > 1_000_000, 0.4).otherwise(0.0) + F.when((number < 1) & F.lower(text_or_empty(salary)).contains("hour"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), total + F.when((words > 0) & (F.size(caps) > words * 0.5), 0.2).otherwise(0.0))


def quality(spam_score: Column | None = None) -> Column:
    title, company, url, text, place, salary = map(F.col, TEXT)
    size = F.length(text)
    by_text = F.when(text_or_empty(text) == "", -3.0).otherwise(F.when(size > 1000, 2.0).when(size > 500, 1.5).when(size > 200, 1.0).when(size < 100, -2.0).otherwise(0.0))
    digits = salary.rlike(r"\d")
    by_salary = F.when(F.trim(text_or_empty(salary)) == "", -1.0).otherwise(F.when(digits, 1.5 + F.when(salary.contains("-"), 0.5).otherwise(0.0)).otherwise(0.0))
    by_company = F.when(F.length(text_or_empty(company)) > 3, 0.5).otherwise(0.0)
    by_place = F.when((text_or_empty(place) != "") & (F.lower(place) != "remote"), 0.5).when(F.trim(text_or_empty(place)) == "", -1.0).otherwise(0.0)
    by_url = F.when(text_or_empty(url) == "", 0.0).when(url.rlike(r"^https?://") & url.contains("."), 0.5).otherwise(-1.0)
    return bounded(5.0 + by_text + by_salary + by_company + by_place + by_url - (spam(title, company, text, salary) if spam_score is None else spam_score) * 2.0)


def company_score(company: Column, url: Column) -> Column:
    size = F.length(company)
    return bounded(5.0 + F.when((text_or_empty(url) != "") & ~holds(url, D.BOARD_DOMAINS), 2.0).otherwise(0.0) + F.when(text_or_empty(company) == "", 0.0).when(size < 3, -2.0).when(size > 100, -1.0).otherwise(0.5))


def remote_authenticity(place: Column) -> Column:
    return (
        F.when(text_or_empty(place) == "", 8.0)
        .when(holds(place, ["remote", "distributed", "anywhere", "global"]), F.when(holds(place, ["timezone", "utc", "est", "pst", "hours", "overlap"]), 7.0).otherwise(10.0))
        .when(holds(place, ["hybrid", "office", "onsite", "new york", "san francisco", "london", "california"]), 2.0)
        .otherwise(5.0)
    )


def salary_quality(salary: Column) -> Column:
    return (
        F.when(text_or_empty(salary) == "", 3.0)
        .when(salary.contains("-"), 9.0)
        .when(salary.rlike(r"\d"), F.when(holds(salary, ["year", "month", "hour", "week", "annual"]), 9.0).when(holds(salary, ["$", "€", "£", "usd", "eur", "gbp"]), 8.0).otherwise(7.0))
        .otherwise(3.0)
    )


def ranked(postings: DataFrame, as_of: str) -> DataFrame:
    """postings with the six parts, final_score, label and spam_indicator."""
    both = F.concat_ws(" ", *(text_or_empty(F.col(c)) for c in ("title", "company", "description")))
    # behind generators, so the texts are joined and lowered once
    rows = spread(postings).select("*", F.inline(F.array(F.struct(both.alias("_both"), F.lower(both).alias("_low")))))
    rows = rows.select("*", F.inline(F.array(F.struct(spam_of(F.col("_both"), F.col("_low"), F.col("title"), F.col("salary")).alias("_spam"))))).drop("_both", "_low")
    parts = {
        "source_trust": source_trust(F.col("source")),
        "freshness": freshness(F.col("posted_at"), as_of),
        "quality": quality(F.col("_spam")),
        "company_score": company_score(F.col("company"), F.col("url")),
        "remote_authenticity": remote_authenticity(F.col("location")),
        "salary_quality": salary_quality(F.col("salary")),
    }
    weights = {("company_score" if k == "company" else k): v for k, v in D.RANK_WEIGHTS.items()}
    out = rows.withColumns({k: v.cast("double") for k, v in parts.items()}).drop("_spam")
    out = out.withColumn("final_score", bounded(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))))
    label = F.when(F.col("remote_authenticity") >= 9, "true-remote").when(F.col("remote_authenticity") >= 5, "hybrid").otherwise("restricted")
    return out.withColumns({"remote_label": label, "spam_indicator": 1.0 - F.col("quality") / 10.0})


def with_percentile(scored: DataFrame) -> DataFrame:
    """Rank by score, then id, and the share of rows at or below. Ranks are global, but no task sorts all rows, nor all of a frequent score: rows are counted by score and range of RANGE ids, only the counts are accumulated, range by range of scores, and rows are numbered within their count."""
    rows = staged(scored.withColumn("_ids", F.floor(F.col("doc_id") / RANGE)), "scores")  # read twice, computed once
    counts = rows.groupBy("final_score", "_ids").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("final_score") * 1000).cast("int"))
    bins = counts.groupBy("bin").agg(F.sum("n").alias("in_bin"))  # at most 10,001 rows
    above_bin = bins.withColumn("above_bin", F.coalesce(F.sum("in_bin").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("in_bin").over(Window.partitionBy()))
    inside = Window.partitionBy("bin").orderBy(F.desc("final_score"), "_ids").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.join(F.broadcast(above_bin), "bin").select("final_score", "_ids", (F.col("above_bin") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), "total")
    tied = Window.partitionBy("final_score", "_ids").orderBy("doc_id")
    out = rows.join(places, ["final_score", "_ids"]).withColumn("rank", (F.col("before") + F.row_number().over(tied)).cast("long"))
    return out.withColumn("percentile", (F.col("total") - F.col("rank") + 1) * 100.0 / F.col("total")).drop("before", "total", "_ids")
