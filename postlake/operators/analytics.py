"""Aggregates of the dashboards: counts, rates, salaries, trends, company figures, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.numbers import days_between, salary_range


def named(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", "Unknown").otherwise(F.col(c))


def counts(df: DataFrame, by: Column, name: str) -> DataFrame:
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n"))


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def source_performance(postings: DataFrame) -> DataFrame:
    n, verified, paid = F.count("*"), F.count_if("verified"), F.count_if(F.col("salary") != "")
    return postings.groupBy("source").agg(n.alias("total"), verified.alias("verified"), rate(verified, n).alias("verified_rate"), paid.alias("with_salary"), rate(F.lit(0) * n + F.count_if(~F.col("is_active")), n).alias("inactive_rate"))


def tech_counts(postings: DataFrame, stack: Column, empty: str | None) -> DataFrame:
    """Postings for each technology; those without any count under ``empty`` or not at all."""
    names = F.when(F.size(stack) == 0, F.array(F.lit(empty))).otherwise(stack) if empty else stack
    return postings.select(F.explode(names).alias("tech")).groupBy("tech").agg(F.count("*").alias("n"))


def calendar(as_of: str, days: int) -> Column:
    day = F.lit(as_of).cast("date")
    return F.explode(F.sequence(F.date_sub(day, days - 1), day))


def daily(postings: DataFrame, as_of: str, days: int) -> DataFrame:
    """Counts for each of the last days, also those without rows."""
    by_day = postings.where("is_active").groupBy(F.col("posted_at").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"), *(F.count_if(F.col("seniority") == s).alias(s) for s in ("junior", "senior", "lead")))
    all_days = postings.sparkSession.range(1).select(calendar(as_of, days).alias("day"))
    return all_days.join(by_day, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "verified", "junior", "senior", "lead")))


def growth(postings: DataFrame, as_of: str, days: int) -> DataFrame:
    """Mean of the last seven days over that of the first seven, and the number of all active postings."""
    place = F.row_number().over(Window.orderBy("day"))  # one row a day
    d = daily(postings, as_of, days).withColumn("i", place)
    first, last = F.avg(F.when(F.col("i") <= 7, F.col("n"))), F.avg(F.when(F.col("i") > days - 7, F.col("n")))
    return d.agg(first.alias("first_avg"), last.alias("last_avg"), rate(last - first, first).alias("growth")).crossJoin(postings.agg(F.count_if("is_active").alias("total_jobs_in_period")))


def middle_salary(low: Column, high: Column) -> Column:
    """The middle of a range, or the end that there is; zero counts as missing."""
    some = lambda c: F.nullif(c, F.lit(0))
    return F.coalesce((some(low) + some(high)) / 2.0, some(low).cast("double"), some(high).cast("double"))


def salaries(postings: DataFrame) -> DataFrame:
    """Mean salaries by seniority, by source and overall; overall counts rows with both ends only."""
    s = postings.withColumn("_s", salary_range(F.col("salary"))).withColumn("mid", middle_salary(F.col("_s.low"), F.col("_s.high"))).withColumn("both", (F.col("_s.low") > 0) & (F.col("_s.high") > 0)).where("mid IS NOT NULL")
    sets = s.groupingSets([["seniority"], ["source"]], "seniority", "source").agg(F.count("*").alias("n"), F.avg("mid").alias("mean"))
    by = sets.select(F.when(F.col("seniority").isNotNull(), "seniority").otherwise("source").alias("dimension"), F.coalesce("seniority", "source").alias("name"), "n", F.round("mean", 2).alias("mean"))
    overall = s.where("both").agg(F.count("*").alias("n"), F.round(F.avg("mid"), 2).alias("mean")).select(F.lit("overall").alias("dimension"), F.lit("all").alias("name"), "n", "mean")
    return by.unionByName(overall)


def company_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("company").agg(F.count("*").alias("n"), rate(F.count_if("verified"), F.count("*"), 1).alias("verified_rate"), *(F.count_if(F.col("seniority") == s).alias(f"n_{s}") for s in ("junior", "senior", "lead")), F.min("posted_at").alias("first_posted"))


def quality_by_day(postings: DataFrame) -> DataFrame:
    return postings.where("posted_at IS NOT NULL").groupBy(F.col("posted_at").cast("date").alias("day"), "source").agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"), F.count_if(F.col("salary") != "").alias("paid"), F.round(F.avg(F.length("body")), 2).alias("mean_length"), rate(F.count_if("verified"), F.count("*")).alias("verified_rate"))


def rollup(postings: DataFrame, unit: str) -> DataFrame:
    """Counts by period, region and seniority with subtotals."""
    return postings.where("posted_at IS NOT NULL").withColumn("period", F.date_trunc(unit, "posted_at").cast("date")).rollup("period", "source", "seniority").agg(F.count("*").alias("n"), F.countDistinct("company").alias("companies"))


def health(runs: DataFrame) -> DataFrame:
    n, failed = F.count("*"), F.count_if(~F.col("ok"))
    return runs.groupBy("source").agg(n.alias("runs"), failed.alias("failed"), rate(failed, n).alias("failure_rate"), F.max("ts").alias("last_run"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success"))


def with_status(failures: DataFrame) -> DataFrame:
    return failures.withColumn("status", F.when(F.col("failures") >= 5, "disabled").when(F.col("failures") >= 2, "degraded").otherwise("healthy"))


def alerts(runs: DataFrame, share: float, per: str = "source") -> DataFrame:
    """Sources of whose runs more than a share failed, with how bad it is."""
    h = health(runs).where(F.col("failed") > F.col("runs") * share)
    return h.select(per, "failure_rate", F.when(F.col("failure_rate") > 35, "critical").when(F.col("failure_rate") > 25, "warning").otherwise("info").alias("severity"))


def pair(dimension: str, name: Column | str, when: Column | None = None) -> Column:
    """An entry of a long table: null, and so left out, where ``when`` doesn't hold."""
    entry = F.struct(F.lit(dimension).alias("dimension"), (F.lit(name) if isinstance(name, str) else name.cast("string")).alias("name"))
    return entry if when is None else F.when(when, entry)


def long_counts(rows: DataFrame, entries: list[Column], named: list[Column], *sums: Column) -> DataFrame:
    """(dimension, name, n, sums) of all entries of rows, by one pass over rows: each is exploded to its entries and these are counted, map sides first. named: entries that are there even where no row has them."""
    each = rows.select("*", F.explode(F.array_compact(F.concat(*entries))).alias("_e")).select("*", "_e.*")
    counted = each.groupBy("dimension", "name").agg(F.count("*").alias("n"), *sums)
    always = rows.sparkSession.range(1).select(F.explode(F.concat(*named)).alias("_e")).select("_e.*")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns[2:]]
    return counted.join(always, ["dimension", "name"], "full").select("dimension", "name", *zero)


def stats(jobs: DataFrame, applied: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """(dimension, name, n) of active jobs: all, those applied to, those read today, and counts by technology, size, source and day. One pass over the jobs."""
    today = F.lit(as_of).cast("date").cast("timestamp_ntz")
    mine = applied.select("doc_id", F.lit(True).alias("mine")).distinct()
    rows = jobs.where("is_active").select("doc_id", "tech_stack", "company_size", "source", "scraped_at", F.coalesce("posted_at", "scraped_at").cast("date").alias("day")).join(mine, "doc_id", "left")
    tech = F.transform(F.split(F.when(F.coalesce("tech_stack", F.lit("")) == "", "Unknown").otherwise(F.col("tech_stack")), ", "), lambda t: pair("tech", t))
    first = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    one = F.array(pair("total", "all"), pair("applied", "all", F.col("mine")), pair("new today", "all", F.col("scraped_at") >= today), pair("size", named("company_size")), pair("source", F.col("source")), pair("day", F.col("day"), F.col("day").between(first, F.lit(as_of).cast("date"))))
    always = [F.array(pair("total", "all"), pair("applied", "all"), pair("new today", "all")), F.transform(F.sequence(first, F.lit(as_of).cast("date")), lambda d: pair("day", d))]
    return long_counts(rows, [one, tech], always)


def overview(jobs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(section, name, value) of the dashboard by one pass over the jobs: active jobs and their verified share by source, and by day; all jobs by region, size, seniority and technology; mean salaries by seniority."""
    day = F.col("posted_at").cast("date")
    first = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    pay = salary_range(F.col("salary"))
    rows = jobs.select("source", "region_eligibility", "company_size", "seniority_tag", "tech_stack", "is_active", "is_verified_remote", day.alias("day"), middle_salary(pay["low"], pay["high"]).alias("mid"))
    tech = F.transform(F.filter(F.split(F.coalesce("tech_stack", F.lit("")), ", "), lambda t: t != ""), lambda t: pair("tech", t))
    active = F.col("is_active")
    one = F.array(pair("source", F.col("source"), active), pair("region", F.col("region_eligibility")), pair("size", F.col("company_size")), pair("salary", F.col("seniority_tag"), F.col("mid").isNotNull()), pair("day", F.col("day"), active & F.col("day").between(first, F.lit(as_of).cast("date"))))
    counted = long_counts(rows, [one, tech], [F.transform(F.sequence(first, F.lit(as_of).cast("date")), lambda d: pair("day", d))], F.count_if("is_verified_remote").alias("verified"), F.sum("mid").alias("pay"))
    entry = lambda section, value: F.struct(section.alias("section"), "name", value.cast("double").alias("value"))
    own = F.when(F.col("dimension") == "salary", F.round(F.col("pay") / F.col("n"), 2)).otherwise(F.col("n"))
    both = F.array(entry(F.col("dimension"), own), F.when(F.col("dimension") == "source", entry(F.lit("verified rate"), rate(F.col("verified"), F.col("n")))))
    return counted.select(F.inline(F.array_compact(both)))


def source_rates(jobs: DataFrame) -> DataFrame:
    """Active jobs by source: all count as matched, and the shares of repeats and of verified remote work."""
    n = F.count("*")
    return jobs.where("is_active").groupBy("source").agg(n.alias("total_scraped"), n.alias("total_matched"), rate(n, n).alias("match_rate"), rate(F.count_if("is_duplicate"), n).alias("duplicate_rate"), rate(F.count_if("is_verified_remote"), n).alias("verified_remote_rate"), F.count_if(F.col("salary") != "").alias("salary_data_available"))


def salaries_by(jobs: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Mean salaries by each of the dimensions, and overall of rows with both ends: one pass by grouping sets."""
    s = jobs.withColumn("_s", salary_range(F.col("salary"))).withColumn("mid", middle_salary(F.col("_s.low"), F.col("_s.high"))).where("mid IS NOT NULL")
    both = (F.col("_s.low") > 0) & (F.col("_s.high") > 0)
    columns = list(dimensions.values())
    sets = s.groupingSets([[c] for c in columns] + [[]], *columns).agg(F.count("*").alias("all"), F.count_if(both).alias("whole"), F.avg("mid").alias("mean"), F.avg(F.when(both, F.col("mid"))).alias("mean_whole"))
    told = F.lit(None).cast("string")
    for dimension, column in dimensions.items():
        told = F.coalesce(F.when(F.col(column).isNotNull(), F.lit(dimension)), told)
    overall = told.isNull()
    return sets.select(F.coalesce(told, F.lit("overall")).alias("dimension"), F.coalesce(*columns, F.lit("all")).alias("name"), F.when(overall, F.col("whole")).otherwise(F.col("all")).alias("n"), F.round(F.when(overall, F.col("mean_whole")).otherwise(F.col("mean")), 2).alias("mean"))


def incremented(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counts by key with those of new rows added; keys of either side stay."""
    return old.unionByName(new).groupBy(key).agg(*(F.sum(c).alias(c) for c in old.columns if c != key))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def quality_view(scored: DataFrame, as_of: str) -> DataFrame:
    """By day and source: counts of repeats, spam and high scores, their shares, and mean score and age."""
    n, repeats, spam = F.count("*"), F.count_if("is_duplicate"), F.count_if(F.col("spam_indicator") > 0.5)
    age = days_between(F.lit(as_of).cast("timestamp_ntz"), F.col("posted_at"))
    return scored.where("posted_at IS NOT NULL").groupBy(F.col("posted_at").cast("date").alias("day"), "source").agg(n.alias("n"), repeats.alias("duplicates"), spam.alias("spam"), F.count_if(F.round("final_score", 6) > 7.0).alias("high_quality"), F.round(F.avg("final_score"), 5).alias("mean_score"), F.round(F.avg(age), 5).alias("mean_age_days"), rate(repeats, n).alias("duplicate_ratio"), rate(spam, n).alias("spam_ratio"))
