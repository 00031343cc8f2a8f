"""Monitoring: gauges of all postings, alerts by thresholds, their counts and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DUPLICATES, MOST_SPAM, FRESH_DAYS = 0.5, 0.3, 7


def share(part: Column) -> Column:
    return F.coalesce(F.avg(part.cast("double")), F.lit(0.0))


def gauges(jobs: DataFrame, active_sources: DataFrame) -> DataFrame:
    """One row: active jobs, the share of repeats among them, the mean of scores above 0, and how many sources are active."""
    out = jobs.where("is_active").agg(F.count("*").alias("total_jobs"), share(F.col("is_duplicate")).alias("duplicate_ratio"), F.coalesce(F.avg(F.when(F.col("final_score") > 0, F.col("final_score"))), F.lit(0.0)).alias("avg_job_score"))
    return out.crossJoin(active_sources.agg(F.count("*").alias("active_sources")))  # one row each


def alert(rows: DataFrame, severity: Column, kind: str, source: Column, value: Column) -> DataFrame:
    return rows.select(severity.alias("severity"), source.alias("source"), F.lit(kind).alias("kind"), value.cast("double").alias("value")).where("severity IS NOT NULL")


def source_alerts(failures: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sources that fail in a row (five times: an error, twice: a warning), and those of whose postings more than half are repeats."""
    bad = F.when(F.col("failures") >= 5, "error").when(F.col("failures") >= 2, "warning")
    ratio = jobs.groupBy("source").agg(share(F.col("is_duplicate")).alias("ratio"))
    return alert(failures, bad, "failures", F.col("source"), F.col("failures")).unionByName(alert(ratio, F.when(F.col("ratio") > MOST_DUPLICATES, "warning"), "duplicates", F.col("source"), F.round("ratio", 6)))


def system_alerts(jobs: DataFrame, as_of: str) -> DataFrame:
    """No posting read for a week, or too much spam among active postings."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(FRESH_DAYS))
    all_jobs = jobs.agg(F.count_if(F.col("scraped_at") >= since).alias("fresh"), share(F.when(F.col("is_active"), F.col("spam_indicator") > 0.5)).alias("spam"))
    fresh = alert(all_jobs, F.when(F.col("fresh") == 0, "warning"), "no fresh jobs", F.lit("system"), F.col("fresh"))
    return fresh.unionByName(alert(all_jobs, F.when(F.col("spam") > MOST_SPAM, "warning"), "spam", F.lit("system"), F.round("spam", 6)))


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("n"))


def status(alerts: DataFrame) -> DataFrame:
    """One row: critical if an alert is, else degraded if one is an error, else healthy; and counts."""
    count = lambda s: F.count_if(F.col("severity") == s)
    state = F.when(count("critical") > 0, "critical").when(count("error") > 0, "degraded").otherwise("healthy")
    return alerts.agg(state.alias("status"), F.count("*").alias("alert_count"), count("critical").alias("critical_alerts"), count("error").alias("error_alerts"), count("warning").alias("warning_alerts"))


def history(alerts: DataFrame, time: str, key: str, most: int = 1000) -> DataFrame:
    """The newest alerts: as many as are kept."""
    return alerts.orderBy(F.desc(time), F.desc(key)).limit(most)


def switched(states: DataFrame, switches: DataFrame) -> DataFrame:
    """states (source, status) with the newest manual switch (source, ts, enabled) of each source over it."""
    last = switches.groupBy("source").agg(F.max_by("enabled", F.struct("ts", "run_id")).alias("enabled"))
    return states.join(last, "source", "left").select("source", F.when(F.col("enabled"), "healthy").when(~F.col("enabled"), "disabled").otherwise(F.col("status")).alias("status"))


def freshness(runs: DataFrame, jobs: DataFrame, as_of: str, hours: int) -> DataFrame:
    """One row: the last good run, whether it is within the interval, the hours since, and how many postings are active."""
    now = F.lit(as_of).cast("timestamp_ntz")
    last = runs.where("ok").agg(F.max("ts").alias("last_scrape_at"))
    gone = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_scrape_at").cast("timestamp"))) / 3600.0
    told = last.select("last_scrape_at", F.coalesce(F.col("last_scrape_at") > now - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False)).alias("is_fresh"), F.round(gone, 1).alias("stale_in_hours"))
    return told.crossJoin(jobs.agg(F.count_if("is_active").alias("active_jobs_count")))  # one row each
