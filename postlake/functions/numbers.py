"""Salaries, years of experience and dates from text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import low_of, text_or_empty


def parse_salary(c: Column) -> Column:
    """Struct of the least and greatest number (a "k" anywhere multiplies all); one number is the least alone."""
    low = F.lower(F.trim(text_or_empty(c)))
    thousands = low.contains("k")
    cleaned = F.when(thousands, F.regexp_replace(low, r"[k$€£,]", "")).otherwise(low)
    found = F.transform(F.regexp_extract_all(cleaned, F.lit(r"(\d[\d,]*)"), F.lit(1)), lambda n: F.try_to_number(F.replace(n, F.lit(","), F.lit("")), F.lit("999999999999")).cast("long") * F.when(thousands, 1000).otherwise(1))
    return F.struct(F.when(F.size(found) > 0, F.array_min(found)).alias("salary_min"), F.when(F.size(found) > 1, F.array_max(found)).alias("salary_max"))


RANGES = (r"(?i)[$€£]?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*[-–to]+\s*[$€£]?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)", r"(?i)(\d{1,3})k\s*[-–to]+\s*(\d{1,3})k")


def salary_range(c: Column) -> Column:
    """Struct of both ends of the first range that is written like one of RANGES."""
    text = text_or_empty(c)
    times = F.when(F.lower(text).contains("k"), 1000).otherwise(1)
    number = lambda p, g: F.floor(F.replace(F.regexp_extract(text, p, g), F.lit(","), F.lit("")).try_cast("double")).cast("long") * times
    end = lambda g: F.coalesce(*(number(p, g) for p in RANGES))
    return F.struct(end(1).alias("low"), end(2).alias("high"))


def experience_ranges(c: Column) -> Column:
    """Array of (low, high): ranges first, then single numbers; high is null after a plus."""
    low = low_of(c)
    span = r"\b(\d{1,2})\s*[-–to]+\s*(\d{1,2})\s*(?:years?|yrs?)\b"
    single = r"\b(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b"
    number = lambda x, p, g: F.regexp_extract(x, p, g).cast("int")
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    spans = F.transform(F.regexp_extract_all(low, F.lit(span), F.lit(0)), lambda x: pair(F.least(number(x, span, 1), number(x, span, 2)), F.greatest(number(x, span, 1), number(x, span, 2))))
    singles = F.transform(F.regexp_extract_all(low, F.lit(single), F.lit(0)), lambda x: pair(number(x, single, 1), F.when(~x.contains("+"), number(x, single, 1))))
    return F.when(tells_years(low), F.concat(spans, singles)).otherwise(F.array().cast("array<struct<low: int, high: int>>"))


def tells_years(low: Column) -> Column:
    """What both kinds of patterns can't do without; without it no pattern runs."""
    return low.contains("year") | low.contains("yr")


def required_years(c: Column) -> Column:
    """Struct (low, high) of the first range, else of a number with a plus, else of a single number up to 20."""
    low = low_of(c)
    span, plus, single = r"(\d{1,2})\s*[-–to]+\s*(\d{1,2})\s*(?:years?|yrs?)", r"(\d{1,2})\s*\+\s*(?:years?|yrs?)", r"(\d{1,2})\s*(?:years?|yrs?)"
    at = lambda p, g: F.regexp_extract(low, p, g).try_cast("int")
    found = F.when(low.rlike(span), F.struct(at(span, 1).alias("low"), at(span, 2).alias("high"))).when(low.rlike(plus), F.struct(at(plus, 1).alias("low"), F.lit(None).cast("int").alias("high"))).when(at(single, 1) <= 20, F.struct(at(single, 1).alias("low"), at(single, 1).alias("high")))
    return F.when(tells_years(low), found)


def parse_datetime(c: Column) -> Column:
    """Epoch seconds or milliseconds, ISO, mail and plain dates; the zone is dropped, not converted."""
    text = F.trim(text_or_empty(c))
    epoch = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    seconds = F.when(epoch > 1e10, F.floor(epoch / 1000)).otherwise(F.floor(epoch)).cast("long")
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*([+-]\d{4}|[A-Z]{1,5})$", "")
    return F.coalesce(F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds), F.when(epoch.isNull(), text.try_cast("timestamp_ntz")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down also below zero."""
    seconds = F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))
    return F.floor(seconds / 86400).cast("long")
