"""The queries that are registered: each over whole tables, most with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import bindings as B
from postlake import dictionaries as D
from postlake.functions import classify as C
from postlake.functions import enrich as E
from postlake.functions import numbers as N
from postlake.functions import text as T
from postlake.functions.tagging import fields, tagged, untagged
from postlake.operators import analytics as A
from postlake.operators import dedup, matching, neardup, semantic, upsert
from postlake.plans import filters, ranking, scoring
from postlake.plans.criteria import Criteria
from postlake.sources.readers import backfilled, page_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = Criteria(min_experience=1, max_experience=5)
P = f"WITH p AS ({B.POSTINGS}) "
R = f"WITH r AS ({B.RUNS}) "


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- the rules as SQL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def letters(expr: str) -> str:
    """expr in lower case with an ASCII letter for each other Latin one: DuckDB takes those for word boundaries, the rules and Spark don't."""
    return f"regexp_replace(lower({expr}), '[\\x{{C0}}-\\x{{24F}}]', 'x', 'g')"


def hits(expr: str, patterns: list[str]) -> str:
    return f"regexp_matches({letters(expr)}, {lit(T.any_of(patterns))})"


def words(expr: str, ws: list[str]) -> str:
    return f"regexp_matches({letters(expr)}, {lit(T.words_pattern(ws))})"


def holds(expr: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {lit(p)})" for p in phrases) + ")"


def case(rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {r} THEN {n}" for r, n in rules) + f" ELSE {otherwise} END"


def replaced(expr: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    return expr


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


TD, TDL, LD, CD = "(title || ' ' || description)", "(title || ' ' || description || ' ' || location)", "(location || ' ' || description)", "(company || ' ' || description)"
NORMAL = lambda e: squeeze(f"regexp_replace(lower({e}), '[^a-z0-9\\s]', '', 'g')")
URL = "lower(rtrim(regexp_replace(url, '[?#].*$', ''), '/'))"
TITLE = f"array_to_string(list_filter(string_split({squeeze(replaced('trim(lower(title))', D.TITLE_FORMS))}, ' '), lambda w: w NOT IN ({', '.join(map(lit, D.STOP_WORDS))})), ' ')"


def _company() -> str:
    out = "trim(lower(company))"
    for suffix in sorted(D.COMPANY_SUFFIXES, key=lambda s: (-len(s), s)):
        out = f"trim(regexp_replace({out}, {lit(re.escape(suffix) + '$')}, ''))"
    return squeeze(out)


COMPANY = _company()
PLACE = squeeze(replaced("trim(lower(location))", [("united states", "us"), ("united kingdom", "uk"), ("remote - ", ""), ("remote ", "")]))
ROLE = f"coalesce({case([(words('title', w), lit(r)) for r, w in D.ROLES.items()])}, {case([(words('description', w), lit(r)) for r, w in D.ROLES.items()])})"
RELEVANT = words(TD, [w for ws in D.ROLES.values() for w in ws])
LEVEL = case([(hits(TD, [r"\bintern\b", r"\btrainee\b"]), "'Intern'"), (hits(TD, D.JUNIOR), "'Junior (0-2 years)'"), (hits(TD, D.SENIOR), "'Senior (excluded)'")], "'Mid-level'")
TAG = case([(hits(TD, D.SENIOR), "'senior'"), (hits(TD, D.JUNIOR), "'junior'")], "'mid'")
SIZE = case([(hits(CD, D.ENTERPRISES), "'Enterprise'"), (hits(CD, D.STARTUPS), "'Startup'")], "'Mid-size'")
REGION = case([(hits(LD, [r"\bworldwide\b", r"\banywhere\b", r"\bglobal\b"]), "'Worldwide'"), (hits(LD, [r"\bindia\b"]), "'India Eligible'"), (hits(LD, [r"\bremote\b"]), "'Remote (unspecified)'")], "'Unknown'")
VERIFIED = f"({hits(TDL, D.VERIFIED_REMOTE)} OR (NOT {hits(TDL, D.NOT_REMOTE)} AND {hits(TDL, [r'\bremote\b'])}))"
GLOBAL = case([(f"{hits('description', D.GLOBAL_IN_TEXT)} AND NOT {hits('description', D.US_ONLY)}", "true"), (hits(LD, D.REGION_ONLY), "false"), (hits(LD, D.ON_SITE), "false"), (hits(LD, D.REMOTE), "true")], f"length(description) > 100 AND {hits('description', D.CLOUD_TOOLS)}")
OUTSIDE = f"NOT ({holds('company', D.INDIAN_COMPANIES)} OR regexp_matches(lower(company), '\\b(india|pvt\\.?\\s*ltd|private limited)\\b'))"
INSIDE = f"({holds('location', D.INDIAN_CITIES)} OR {holds('description', D.INDIAN_CITIES)} OR (({holds('location', D.INDIAN_STATES)} OR {holds('description', D.INDIAN_STATES)}) AND NOT {hits('description', D.REMOTE)}) OR {hits(LD, [r'\bpincode\b', r'\bpin\s*code\b', r'\bindian\s+(?:time|rupees|standard|subcontinent)'])} OR ({hits('location', [r'\bindia\b'])} AND NOT {hits('description', D.REMOTE)}))"
FAKE_TEXT = "(title || ' ' || description || ' ' || company)"
FAKE = f"({hits(FAKE_TEXT, D.FAKE)} OR {hits(FAKE_TEXT, D.SUSPICIOUS)} OR len(regexp_extract_all(lower({FAKE_TEXT}), {lit(D.URGENT)})) >= 3 OR regexp_matches(lower({FAKE_TEXT}), '\\b\\d+.*\\bdollar\\b.*\\bdaily\\b'))"
STACK = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {hits('description', ps)} THEN {lit(n)} END" for n, ps in D.TECH.items()) + "], lambda x: x IS NOT NULL))"
SPAN, SINGLE = "\\b(\\d{1,2})\\s*[-–to]+\\s*(\\d{1,2})\\s*(?:years?|yrs?)\\b", "\\b(\\d{1,2})\\s*\\+?\\s*(?:years?|yrs?)\\b"


def ranges(expr: str) -> str:
    e = f"lower({expr})"
    n = lambda p, g: f"regexp_extract(x, '{p}', {g})::INT"
    return f"list_concat(list_transform(regexp_extract_all({e}, '{SPAN}'), lambda x: {{'low': least({n(SPAN, 1)}, {n(SPAN, 2)}), 'high': greatest({n(SPAN, 1)}, {n(SPAN, 2)})}}), list_transform(regexp_extract_all({e}, '{SINGLE}'), lambda x: {{'low': {n(SINGLE, 1)}, 'high': CASE WHEN contains(x, '+') THEN NULL ELSE {n(SINGLE, 1)} END}}))"


def terms_in(expr: str) -> str:
    return "(" + " + ".join(f"contains(lower({expr}), {lit(t)})::INT" for t in Q.terms) + ")"


MATCHES = f"({terms_in('title')} >= 1 OR coalesce({ROLE} = {lit(Q.role or '')}, false) OR {terms_in(TD)} >= {max(1, max(1, min(2, len(Q.terms))) - 1)} OR {RELEVANT})"
FITS = f"(len({ranges(TDL)}) = 0 OR len(list_filter({ranges(TDL)}, lambda r: r.low <= {Q.max_experience} AND coalesce(r.high, 99) >= {Q.min_experience})) > 0)"
REASON = case(
    [
        (FAKE, "'fake'"),
        (f"NOT {MATCHES}", "'query'"),
        (f"NOT {FITS}", "'experience'"),
        (f"NOT ({GLOBAL} OR {hits(TDL, [r'\bremote\b'])} OR location = '')", "'not remote'"),
        (f"({REGION}) = 'Unknown' AND NOT {hits(LD, [r'\bremote\b'])}", "'region'"),
        (f"NOT ({OUTSIDE})", "'company'"),
        (INSIDE, "'place'"),
        (f"NOT coalesce(posted_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL {Q.posted_within_days} DAY, true)", "'too old'"),
    ]
)


def postings(spark, sf):
    return B.postings(spark, sf)


def verified(df: DataFrame) -> DataFrame:
    f = fields()
    return untagged(tagged(df).withColumn("verified", C.verified_remote(f["location"], f["description"], f["title"])))


# ---- flagship


@query()
def relevance_pipeline(spark, sf):
    """Normalise, filter, score, de-duplicate and rank postings; the most relevant first."""
    kept = filters.passing(detailed(spark, sf), Q)
    best = dedup.by_signature(scoring.relevance(kept, Q).select("doc_id", "title", "company", "url", "source", "relevance_score"))
    return best.where("relevance_score >= 0.3").select("doc_id", "title", "source", "relevance_score").orderBy(F.desc("relevance_score"), "doc_id").limit(500)


def detailed(spark, sf) -> DataFrame:
    """Postings, tagged, with what scoring reads: salaries, years, skills and lists."""
    s, r = N.parse_salary(F.col("salary")), N.required_years(fields()["description"])
    empty = F.array().cast("array<string>")
    return tagged(postings(spark, sf)).withColumns({"salary_min": s["salary_min"], "salary_max": s["salary_max"], "experience_min": r["low"], "experience_max": r["high"], "skills": C.tech_stack(fields()["description"]), "tags": empty, "requirements": empty, "responsibilities": empty})


# ---- scalar rules


@query(P + f"SELECT doc_id, {NORMAL('title')} AS title, {URL} AS url, substr(sha256({NORMAL('title')} || '|' || {NORMAL('company')} || '|' || {URL}), 1, 16) AS signature FROM p")
def normalize_and_sign(spark, sf):
    p = postings(spark, sf)
    return p.select("doc_id", T.normal_text(F.col("title")).alias("title"), T.normal_url(F.col("url")).alias("url"), T.signature(F.col("title"), F.col("company"), F.col("url")).alias("signature"))


@query(P + f"SELECT doc_id, {TITLE} AS title, {COMPANY} AS company, {PLACE} AS location, md5({TITLE} || '|' || {COMPANY} || '|' || {PLACE}) AS cluster FROM p")
def standard_forms(spark, sf):
    p = postings(spark, sf)
    t, c, l = (F.col(x) for x in ("title", "company", "location"))
    return p.select("doc_id", T.standard_title(t).alias("title"), T.standard_company(c).alias("company"), T.standard_location(l).alias("location"), T.cluster_md5(t, c, l).alias("cluster"))


@query(P + "SELECT doc_id, substr(sha256(source || ':' || CASE WHEN url <> '' THEN url ELSE title END), 1, 32) AS new_id, md5(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', '', 'g')) || '|' || trim(regexp_replace(lower(company), '[^\\p{L}\\p{N}_\\s]', '', 'g'))) AS signature FROM p")
def hashed_ids(spark, sf):
    return postings(spark, sf).select("doc_id", T.external_id(F.col("source"), F.col("url"), F.col("title")).alias("new_id"), T.title_company_md5(F.col("title"), F.col("company")).alias("signature"))


@query(
    P
    + """, s AS (SELECT *, contains(lower(salary), 'k') AS k, CASE WHEN contains(lower(salary), 'k') THEN regexp_replace(lower(trim(salary)), '[k$€£,]', '', 'g') ELSE lower(trim(salary)) END AS t FROM p),
v AS (SELECT *, list_transform(regexp_extract_all(t, '(\\d[\\d,]*)'), lambda n: replace(n, ',', '')::BIGINT * CASE WHEN k THEN 1000 ELSE 1 END) AS v FROM s)
SELECT doc_id, list_min(v) AS salary_min, CASE WHEN len(v) > 1 THEN list_max(v) END AS salary_max FROM v"""
)
def parsed_salary(spark, sf):
    s = N.parse_salary(F.col("salary"))
    return postings(spark, sf).select("doc_id", s["salary_min"].alias("salary_min"), s["salary_max"].alias("salary_max"))


SALARY_RANGE = ", ".join(
    f"coalesce(floor(try_cast(replace(regexp_extract(salary, '{N.RANGES[0]}', {g}), ',', '') AS DOUBLE)), floor(try_cast(regexp_extract(salary, '{N.RANGES[1]}', {g}) AS DOUBLE)))::BIGINT * CASE WHEN contains(lower(salary), 'k') THEN 1000 ELSE 1 END AS {n}" for g, n in ((1, "low"), (2, "high"))
)


@query(P + f"SELECT doc_id, {SALARY_RANGE} FROM p")
def salary_ranges(spark, sf):
    s = N.salary_range(F.col("salary"))
    return postings(spark, sf).select("doc_id", s["low"].alias("low"), s["high"].alias("high"))


@query(P + f", e AS (SELECT doc_id, unnest({ranges('description')}) AS r FROM p) SELECT doc_id, r.low AS low, r.high AS high, count(*) AS n FROM e GROUP BY ALL")
def experience_ranges(spark, sf):
    e = postings(spark, sf).select("doc_id", F.explode(N.experience_ranges(F.col("description"))).alias("r"))
    return e.groupBy("doc_id", "r.low", "r.high").agg(F.count("*").alias("n"))


@query(P + f", s AS (SELECT doc_id, {STACK} AS s FROM p) SELECT doc_id, array_to_string(s, ', ') AS tech_stack, len(s)::INT AS n FROM s")
def tech_extract(spark, sf):
    s = C.tech_stack(fields()["description"])
    return tagged(postings(spark, sf)).select("doc_id", F.array_join(s, ", ").alias("tech_stack"), F.size(s).alias("n"))


@query(P + f"SELECT doc_id, {ROLE} AS role, {RELEVANT} AS relevant, {LEVEL} AS level, {TAG} AS tag, {SIZE} AS size, {REGION} AS region, {VERIFIED} AS verified, {GLOBAL} AS eligible, {OUTSIDE} AS outside, {INSIDE} AS inside, {FAKE} AS fake FROM p")
def classified(spark, sf):
    t, d, c, l = (fields()[x] for x in ("title", "description", "company", "location"))
    return tagged(postings(spark, sf)).select("doc_id", C.role_category(t, d).alias("role"), C.is_relevant_role(t, d).alias("relevant"), C.experience_level(t, d).alias("level"), C.seniority_tag(t, d).alias("tag"), C.company_size(c, d).alias("size"), C.region(l, d).alias("region"), C.verified_remote(l, d, t).alias("verified"), C.globally_remote(l, d).alias("eligible"), C.outside_india(c).alias("outside"), C.in_india(l, d).alias("inside"), C.likely_fake(t, d, c).alias("fake"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, length(html)::INT AS size FROM pages")
def page_titles(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", T.page_title(F.col("html")).alias("title"), F.length("html").alias("size"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)href=[\"'']([^\"''#]+)', 1))) AS link FROM pages")
def page_link_list(spark, sf):
    return page_links(B.table(spark, sf, "pages"))


def tagless_sql(e: str) -> str:
    e = f"regexp_replace(regexp_replace({e}, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
    return squeeze(replaced(e, [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]))


@query(f"SELECT page_id, md5({tagless_sql('html')}) AS text_md5 FROM pages")
def page_text(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", F.md5(T.without_tags(F.col("html"))).alias("text_md5"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def event_props(spark, sf):
    return B.table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(P + f"SELECT doc_id, round(10 * exp(-greatest(epoch(TIMESTAMP '{B.AS_OF}' - posted_at) / 86400.0, 0) / 7), 6) AS decay, floor(epoch(TIMESTAMP '{B.AS_OF}' - posted_at) / 86400)::BIGINT AS days FROM p WHERE posted_at IS NOT NULL")
def freshness_decay(spark, sf):
    return postings(spark, sf).where("posted_at IS NOT NULL").select("doc_id", F.round(ranking.freshness(F.col("posted_at"), B.AS_OF), 6).alias("decay"), N.days_between(F.lit(B.AS_OF).cast("timestamp_ntz"), F.col("posted_at")).alias("days"))


# ---- filters and pages


@query(P + f"SELECT doc_id, {REASON} AS reason FROM p")
def filter_cascade(spark, sf):
    return tagged(postings(spark, sf)).select("doc_id", filters.reject_reason(Q, fields()).alias("reason"))


@query(P + "SELECT doc_id, title, posted_at FROM p WHERE is_active AND source = 'greenhouse' AND (contains(lower(title), 'engineer') OR contains(lower(description), 'python')) ORDER BY posted_at DESC NULLS LAST, doc_id LIMIT 50 OFFSET 10")
def list_page(spark, sf):
    p = postings(spark, sf).where(F.col("is_active") & (F.col("source") == "greenhouse") & (F.lower("title").contains("engineer") | F.lower("description").contains("python")))
    return p.orderBy(F.desc_nulls_last("posted_at"), "doc_id").offset(10).limit(50).select("doc_id", "title", "posted_at")


APPLIED = "SELECT DISTINCT o_custkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT'"


def applications(spark, sf):
    return B.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("doc_id"))


@query(P + f", a AS ({APPLIED}) SELECT doc_id, title FROM p WHERE doc_id IN (SELECT doc_id FROM a)")
def applied_semi(spark, sf):
    return postings(spark, sf).join(applications(spark, sf), "doc_id", "left_semi").select("doc_id", "title")


@query(P + f", a AS ({APPLIED}) SELECT doc_id, title FROM p WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def unapplied_anti(spark, sf):
    return postings(spark, sf).join(applications(spark, sf), "doc_id", "left_anti").select("doc_id", "title")


@query(P + f", a AS ({APPLIED}) SELECT source, sum((a.doc_id IS NOT NULL)::INT)::BIGINT AS applied, count(*) AS n FROM p LEFT JOIN a USING (doc_id) GROUP BY 1")
def applied_overlay(spark, sf):
    return upsert.applied(postings(spark, sf), applications(spark, sf)).groupBy("source").agg(F.count_if("is_applied").alias("applied"), F.count("*").alias("n"))


# ---- aggregates


VERIFIED_P = P + f", v AS (SELECT *, {VERIFIED} AS verified FROM p) "


@query(VERIFIED_P + "SELECT source, count(*) AS total, count_if(verified)::BIGINT AS verified, round(count_if(verified) * 100.0::DOUBLE / count(*), 2) AS verified_rate, count_if(salary <> '')::BIGINT AS with_salary, round(count_if(NOT is_active) * 100.0::DOUBLE / count(*), 2) AS inactive_rate FROM v GROUP BY 1")
def source_performance(spark, sf):
    return A.source_performance(verified(postings(spark, sf)))


@query(P + f"SELECT 'region' AS dimension, {REGION} AS name, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'size', {SIZE}, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'role', coalesce({ROLE}, 'Unknown'), count(*) FROM p GROUP BY 2")
def market_heatmap(spark, sf):
    t, d, c, l = (fields()[x] for x in ("title", "description", "company", "location"))
    named = tagged(postings(spark, sf)).select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("name")) for k, v in (("region", C.region(l, d)), ("size", C.company_size(c, d)), ("role", F.coalesce(C.role_category(t, d), F.lit("Unknown"))))))).alias("x"))
    return named.groupBy("x.dimension", "x.name").agg(F.count("*").alias("n"))


@query(P + f", s AS (SELECT {STACK} AS s FROM p) SELECT unnest(CASE WHEN len(s) = 0 THEN ['Unknown'] ELSE s END) AS tech, count(*) AS n FROM s GROUP BY 1")
def stats_by_tech(spark, sf):
    return A.tech_counts(tagged(postings(spark, sf)), C.tech_stack(fields()["description"]), "Unknown")


@query(P + f", s AS (SELECT unnest({STACK}) AS tech FROM p) SELECT tech, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, tech LIMIT 20")
def tech_top20(spark, sf):
    return A.tech_counts(tagged(postings(spark, sf)), C.tech_stack(fields()["description"]), None).orderBy(F.desc("n"), "tech").limit(20)


DAYS = f"(SELECT unnest(generate_series(DATE '{B.AS_OF[:10]}' - 29, DATE '{B.AS_OF[:10]}', INTERVAL 1 DAY))::DATE AS day)"
DAILY = f"d AS (SELECT c.day, count(v.doc_id) AS n, count_if(coalesce(v.verified, false))::BIGINT AS verified, count(*) FILTER (v.seniority = 'junior') AS junior, count(*) FILTER (v.seniority = 'senior') AS senior, count(*) FILTER (v.seniority = 'lead') AS lead FROM {DAYS} c LEFT JOIN (SELECT * FROM v WHERE is_active) v ON v.posted_at::DATE = c.day GROUP BY 1)"


@query(VERIFIED_P + f", {DAILY} SELECT * FROM d")
def hiring_trend_daily(spark, sf):
    return A.daily(verified(postings(spark, sf)), B.AS_OF, 30)


@query(VERIFIED_P + f", {DAILY}, i AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM d), g AS (SELECT avg(n) FILTER (i <= 7) AS first_avg, avg(n) FILTER (i > 23) AS last_avg FROM i) SELECT first_avg, last_avg, round(coalesce((last_avg - first_avg) * 100.0::DOUBLE / nullif(first_avg, 0), 0), 2) AS growth, (SELECT count_if(is_active) FROM p)::BIGINT AS total_jobs_in_period FROM g")
def hiring_growth(spark, sf):
    return A.growth(verified(postings(spark, sf)), B.AS_OF, 30)


@query(
    P
    + f""", s AS (SELECT *, {SALARY_RANGE} FROM p), m AS (SELECT *, coalesce((nullif(low, 0) + nullif(high, 0)) / 2.0::DOUBLE, nullif(low, 0)::DOUBLE, nullif(high, 0)::DOUBLE) AS mid FROM s)
SELECT 'seniority' AS dimension, seniority AS name, count(*) AS n, round(avg(mid), 2) AS mean FROM m WHERE mid IS NOT NULL GROUP BY 2
UNION ALL SELECT 'source', source, count(*), round(avg(mid), 2) FROM m WHERE mid IS NOT NULL GROUP BY 2
UNION ALL SELECT 'overall', 'all', count(*), round(avg(mid), 2) FROM m WHERE low > 0 AND high > 0"""
)
def salary_insights(spark, sf):
    return A.salaries(postings(spark, sf))


@query(VERIFIED_P + "SELECT company, count(*) AS n, round(count_if(verified) * 100.0::DOUBLE / count(*), 1) AS verified_rate, count_if(seniority = 'junior')::BIGINT AS n_junior, count_if(seniority = 'senior')::BIGINT AS n_senior, count_if(seniority = 'lead')::BIGINT AS n_lead, min(posted_at) AS first_posted FROM v GROUP BY 1")
def company_stats(spark, sf):
    return A.company_stats(verified(postings(spark, sf)))


@query(P + f", s AS (SELECT company, unnest({STACK}) AS tech FROM p), c AS (SELECT company, tech, count(*) AS n FROM s GROUP BY 1, 2) SELECT company, tech, n FROM c QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, tech) <= 10")
def company_top10_tech(spark, sf):
    s = tagged(postings(spark, sf)).select("company", F.explode(C.tech_stack(fields()["description"])).alias("tech")).groupBy("company", "tech").agg(F.count("*").alias("n"))
    return dedup.latest_per(s, "company", 10, F.desc("n"), F.col("tech"))


@query(VERIFIED_P + "SELECT posted_at::DATE AS day, source, count(*) AS n, count_if(verified)::BIGINT AS verified, count_if(salary <> '')::BIGINT AS paid, round(avg(length(body)), 2) AS mean_length, round(count_if(verified) * 100.0::DOUBLE / count(*), 2) AS verified_rate FROM v WHERE posted_at IS NOT NULL GROUP BY 1, 2")
def quality_metrics(spark, sf):
    return A.quality_by_day(verified(postings(spark, sf)))


@query(P + "SELECT date_trunc('week', posted_at)::DATE AS period, source, seniority, count(*) AS n, count(DISTINCT company) AS companies FROM p WHERE posted_at IS NOT NULL GROUP BY ROLLUP (1, 2, 3)")
def period_rollup(spark, sf):
    return A.rollup(postings(spark, sf), "week")


@query(P + "SELECT source, title, count(*) AS n, list_min(list(doc_id)) AS first_id FROM p GROUP BY 1, 2 HAVING count(*) > 5")
def frequent_titles(spark, sf):
    return postings(spark, sf).groupBy("source", "title").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 5")


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents WHERE lang = 'en'), c AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1) SELECT word, n, docs FROM c WHERE n >= 2 ORDER BY n DESC, word LIMIT 30")
def keyword_topk(spark, sf):
    w = B.table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    per = w.groupBy("word", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs")).where("n >= 2").orderBy(F.desc("n"), "word").limit(30)


# ---- windows and sets


@query(P + "SELECT doc_id, external_id FROM p QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY doc_id) = 1")
def exact_dedup(spark, sf):
    return dedup.exact(postings(spark, sf)).select("doc_id", "external_id")


@query(P + f", s AS (SELECT md5({TITLE} || '|' || {COMPANY} || '|' || {PLACE}) AS group_key, source, doc_id FROM p) SELECT group_key, count(*) AS n, min(doc_id) AS first_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM s GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return dedup.groups_by_key(postings(spark, sf), T.cluster_md5(F.col("title"), F.col("company"), F.col("location")))


@query(P + f"SELECT doc_id, title, posted_at FROM p WHERE is_active AND posted_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 7 DAY ORDER BY posted_at DESC, doc_id LIMIT 20")
def hot_jobs(spark, sf):
    recent = postings(spark, sf).where(F.col("is_active") & (F.col("posted_at") >= F.lit(B.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7))))
    return dedup.top_by(recent, 20, F.desc("posted_at"), F.col("doc_id")).select("doc_id", "title", "posted_at")


@query(R + ", g AS (SELECT source, max({'ts': ts, 'run_id': run_id}) FILTER (ok) AS good FROM r GROUP BY 1) SELECT r.source, count_if(NOT ok AND (good IS NULL OR {'ts': ts, 'run_id': run_id} > good))::BIGINT AS failures, CASE WHEN count_if(NOT ok AND (good IS NULL OR {'ts': ts, 'run_id': run_id} > good)) >= 5 THEN 'disabled' WHEN count_if(NOT ok AND (good IS NULL OR {'ts': ts, 'run_id': run_id} > good)) >= 2 THEN 'degraded' ELSE 'healthy' END AS status FROM r JOIN g USING (source) GROUP BY 1")
def consecutive_failures(spark, sf):
    return A.with_status(dedup.running_failures(B.runs(spark, sf)))


@query(R + "SELECT source, count(*) AS runs, count_if(NOT ok)::BIGINT AS failed, round(count_if(NOT ok) * 100.0::DOUBLE / count(*), 2) AS failure_rate, max(ts) AS last_run, max(ts) FILTER (ok) AS last_success FROM r GROUP BY 1")
def source_health(spark, sf):
    return A.health(B.runs(spark, sf))


@query(R + ", h AS (SELECT source, count(*) AS n, count_if(NOT ok) AS f FROM r GROUP BY 1) SELECT source, round(f * 100.0::DOUBLE / n, 2) AS failure_rate, CASE WHEN round(f * 100.0::DOUBLE / n, 2) > 35 THEN 'critical' WHEN round(f * 100.0::DOUBLE / n, 2) > 25 THEN 'warning' ELSE 'info' END AS severity FROM h WHERE f > n * 0.15")
def health_alerts(spark, sf):
    return A.alerts(B.runs(spark, sf), 0.15)


@query(R + "SELECT source, run_id, ts, event_type FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, run_id DESC) <= 5")
def audit_latest(spark, sf):
    return dedup.latest_per(B.runs(spark, sf), "source", 5, F.desc("ts"), F.desc("run_id")).select("source", "run_id", "ts", "event_type")


@query(R + "SELECT source, ts::DATE AS day, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY source ORDER BY ts::DATE RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 2)::BIGINT AS week FROM r GROUP BY 1, 2")
def rolling_week(spark, sf):
    from pyspark.sql import Window

    d = B.runs(spark, sf).groupBy("source", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("week", F.sum("n").over(Window.partitionBy("source").orderBy(F.datediff("day", F.lit("2000-01-01"))).rangeBetween(-6, 0)))


# ---- joins


@query(P + "SELECT p.doc_id, p.source, l.quality, l.toxic FROM p LEFT JOIN labels l USING (doc_id) WHERE p.is_active AND coalesce(l.toxic, 0) = 0 AND p.posted_at >= TIMESTAMP '" + B.AS_OF + "' - INTERVAL 30 DAY")
def recent_quality_jobs(spark, sf):
    p = postings(spark, sf).where(F.col("is_active") & (F.col("posted_at") >= F.lit(B.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(30))))
    return p.join(B.table(spark, sf, "labels"), "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0).select("doc_id", "source", "quality", "toxic")


@query("SELECT n_name AS country, c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def company_dimension(spark, sf):
    """Orders by country and segment: the counts by customer go first, so the join carries one row a customer."""
    per = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    c = B.table(spark, sf, "customer").join(B.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return per.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment")).agg(F.sum("k").alias("n"), F.round(F.sum("s"), 2).alias("total"))


NEW = "SELECT external_id, max_by(title, -doc_id) AS title, max_by(salary, -doc_id) AS salary, max_by(company, -doc_id) AS company FROM p WHERE doc_id % 2 = 1 GROUP BY 1"
OLD = "SELECT external_id, max_by(title, -doc_id) AS title, max_by(salary, -doc_id) AS salary, max_by(company, -doc_id) AS company FROM p WHERE doc_id % 3 = 0 GROUP BY 1"


@query(P + f", o AS ({OLD}), n AS ({NEW}) SELECT external_id, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(nullif(n.salary, ''), o.salary) AS salary, coalesce(nullif(n.company, ''), o.company) AS company FROM o FULL JOIN n USING (external_id)")
def upsert_merge(spark, sf):
    """Two loads of the same postings: every third row was there, every second comes anew."""
    p = postings(spark, sf)
    old = dedup.first_per(p.where("doc_id % 3 = 0").select("external_id", "title", "salary", "company", "doc_id"), ["external_id"], F.col("doc_id")).drop("doc_id")
    new = p.where("doc_id % 2 = 1").select("external_id", "title", "salary", "company", "doc_id")
    return upsert.merged(old, new, "external_id", "doc_id")


@query(P + "SELECT doc_id, doc_id IN (SELECT doc_id FROM p WHERE source = 'remotive') AS is_active FROM p")
def snapshot_activation(spark, sf):
    p = postings(spark, sf).select("doc_id", "is_active", "source")
    return upsert.activated(p, p.where("source = 'remotive'"), "doc_id").select("doc_id", "is_active")


@query(P + ", t AS (SELECT url, max(" + tagless_sql("html") + ") AS page FROM pages GROUP BY 1) SELECT p.doc_id, md5(CASE WHEN length(phrase) < 100 AND NOT " + holds("coalesce(url, '')", D.BLOCKED_HOSTS) + " AND page IS NOT NULL THEN page ELSE phrase END) AS d FROM (SELECT p.* REPLACE (q.url AS url) FROM p LEFT JOIN pages q ON q.page_id = p.doc_id) p LEFT JOIN t USING (url)")
def description_backfill(spark, sf):
    pages = B.table(spark, sf, "pages")
    p = postings(spark, sf).drop("url").withColumn("description", F.col("phrase")).join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    return backfilled(p, pages).select("doc_id", F.md5("description").alias("d"))


# ---- scores


@query()
def relevance_scores(spark, sf):
    return scoring.relevance(detailed(spark, sf), Q).select("doc_id", *(f"s_{k}" for k in D.RELEVANCE_WEIGHTS), "relevance_score")


TRUST = case([(f"lower(source) = {lit(k)}", f"{v}::DOUBLE") for k, v in D.TRUST.items()], f"{D.TRUST_UNKNOWN}::DOUBLE")
AUTHENTIC = case(
    [
        ("location = ''", "8.0::DOUBLE"),
        (holds("location", ["remote", "distributed", "anywhere", "global"]), case([(holds("location", ["timezone", "utc", "est", "pst", "hours", "overlap"]), "7.0::DOUBLE")], "10.0::DOUBLE")),
        (holds("location", ["hybrid", "office", "onsite", "new york", "san francisco", "london", "california"]), "2.0::DOUBLE"),
    ],
    "5.0::DOUBLE",
)
PAY = case([("salary = ''", "3.0::DOUBLE"), ("contains(salary, '-')", "9.0::DOUBLE"), ("regexp_matches(salary, '\\d')", case([(holds("salary", ["year", "month", "hour", "week", "annual"]), "9.0::DOUBLE"), (holds("salary", ["$", "€", "£", "usd", "eur", "gbp"]), "8.0::DOUBLE")], "7.0::DOUBLE"))], "3.0::DOUBLE")
FIRM = f"greatest(0, least(10, 5.0::DOUBLE + CASE WHEN url <> '' AND NOT {holds('url', D.BOARD_DOMAINS)} THEN 2.0 ELSE 0.0 END + CASE WHEN company = '' THEN 0.0 WHEN length(company) < 3 THEN -2.0 WHEN length(company) > 100 THEN -1.0 ELSE 0.5 END))"
FRESH = f"CASE WHEN posted_at IS NULL THEN 5.0::DOUBLE ELSE 10 * exp(-greatest(epoch(TIMESTAMP '{B.AS_OF}' - posted_at) / 86400.0, 0) / 7) END"


@query(P + f"SELECT doc_id, {TRUST} AS source_trust, {AUTHENTIC} AS remote_authenticity, {PAY} AS salary_quality, {FIRM} AS company_score, round({FRESH}, 6) AS freshness FROM p")
def ranking_components(spark, sf):
    return ranking.ranked(postings(spark, sf), B.AS_OF).select("doc_id", "source_trust", "remote_authenticity", "salary_quality", "company_score", F.round("freshness", 6).alias("freshness"))


@query()
def ranking_percentile(spark, sf):
    scored = ranking.ranked(postings(spark, sf), B.AS_OF).select("doc_id", "source", F.round("final_score", 6).alias("final_score"), "remote_label", "spam_indicator")
    return ranking.with_percentile(scored)


CVS = [(1, ["python", "sql", "aws", "docker", "kubernetes"], ["devops engineer", "site reliability engineer"], 4), (2, ["java", "spring", "sql"], ["backend developer"], 1), (3, ["react", "typescript", "graphql"], ["frontend developer", "full stack developer"], 7), (4, ["go", "rust", "terraform"], [], None), (5, ["machine learning", "python"], ["data scientist"], 10)]


def cvs(spark, sf, where: str = "true") -> DataFrame:
    """The CVs above, and one of each hundredth document: the technologies, title and long words of its posting. Of these, those for which ``where`` holds."""
    given = spark.createDataFrame([(*c, []) for c in CVS], "cv_id long, skills array<string>, roles array<string>, years int, keywords array<string>")
    p = tagged(postings(spark, sf).where("doc_id % 100 = 0"))
    keywords = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("body", F.lit(""))), F.lit("[a-z]{6,}"), F.lit(0)))), 1, 10)
    return given.unionByName(p.select(F.col("doc_id").alias("cv_id"), F.transform(C.tech_stack(fields()["description"]), F.lower).alias("skills"), F.array(F.lower("title")).alias("roles"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 13).cast("int").alias("years"), keywords.alias("keywords"))).where(where)


def matchable(spark, sf, where: str = "is_active") -> DataFrame:
    """What CVs are matched with: of the active postings those for which ``where`` holds."""
    t, d, l = (fields()[x] for x in ("title", "description", "location"))
    p = tagged(postings(spark, sf).where("is_active").where(where)).withColumn("pay", N.parse_salary(F.col("salary")))
    return p.select("doc_id", "title", "description", F.transform(C.tech_stack(d), F.lower).alias("tech"), C.experience_level(t, d).alias("level"), C.seniority_tag(t, d).alias("seniority_tag"), C.verified_remote(l, d, t).alias("verified"), C.region(l, d).alias("region"), "pay.salary_min", "pay.salary_max")


@query()
def cv_match(spark, sf):
    return matching.all_scores(cvs(spark, sf), matchable(spark, sf))


def activity(lines: DataFrame) -> DataFrame:
    """The counts of each CV. Lines move once, to their CV; there distinct values are grouped, and only sums go on. One aggregate of several distinct counts would send each line once for each of them, and then each task's part of each CV."""
    few = ("o_orderpriority", "l_returnflag", "l_linestatus")
    own = lines.select(F.col("o_custkey").alias("cv_id"), "l_partkey", "l_suppkey", "l_linenumber", *few).repartition("cv_id")
    parts = own.groupBy("cv_id", "l_partkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("chars"))
    size = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731  of few values
    told = [
        parts.groupBy("cv_id").agg(F.count("l_partkey").alias("n_tech"), F.sum("n").alias("n_skills"), F.sum("chars").alias("keyword_chars")),
        own.groupBy("cv_id", "l_suppkey").count().groupBy("cv_id").agg(F.count("l_suppkey").alias("n_keywords")),
        own.groupBy("cv_id", *few).count().groupBy("cv_id").agg(*(size(c).alias(n) for c, n in zip(few, ("n_roles", "n_education", "n_certificates"), strict=True))),
    ]
    rows = told[0].unionByName(told[1], allowMissingColumns=True).unionByName(told[2], allowMissingColumns=True)
    return rows.groupBy("cv_id").agg(*(F.sum(c).alias(c) for c in rows.columns if c != "cv_id"))


@query("""WITH c AS (SELECT o_custkey AS cv_id, count(DISTINCT l_partkey) AS n_tech, count(*) AS n_skills, count(DISTINCT o_orderpriority) AS n_roles, count(DISTINCT l_suppkey) AS n_keywords, count(DISTINCT l_returnflag) AS n_education, count(DISTINCT l_linestatus) AS n_certificates,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 12 END AS years, sum(l_linenumber)::BIGINT AS keyword_chars FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
s AS (SELECT cv_id, least(100, floor(least(15, (n_tech > 0)::INT * 3 + (n_roles > 0)::INT * 3 + (n_education > 0)::INT * 3 + (n_keywords > 0)::INT * 3 + (years IS NOT NULL)::INT * 3) + least(20.0::DOUBLE, n_tech * 1.5::DOUBLE + n_skills * 0.5::DOUBLE)
  + CASE WHEN years IS NULL THEN 0 WHEN years <= 2 THEN 5 WHEN years <= 5 THEN 10 ELSE 15 END + least(15, n_roles * 5) + least(15.0::DOUBLE, n_keywords * 1.5::DOUBLE) + least(10, n_education * 3 + n_certificates * 2) + CASE WHEN keyword_chars + n_skills * 2 > 20 THEN 5 ELSE 0 END))::INT AS score FROM c)
SELECT cv_id, score, CASE WHEN score >= 80 THEN 'Strong' WHEN score >= 60 THEN 'Good' ELSE 'Needs work' END AS rating FROM s""")
def ats_score(spark, sf):
    j = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(B.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), F.col("o_orderkey") == F.col("l_orderkey"))
    return matching.ats(activity(j).withColumn("years", F.when(F.col("cv_id") % 7 != 0, F.col("cv_id") % 12))).select("cv_id", "score", "rating")


# ---- similarity


@query("WITH s AS (SELECT a.vec_id, b.vec_id AS other_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT vec_id, other_id, round(s, 6) AS similarity FROM s WHERE s >= 0.35")
def semantic_pairs(spark, sf):
    """The query set of ids divisible by 100 against all vectors, whatever their labels."""
    return semantic.search(B.table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 0.35).withColumn("similarity", F.round("similarity", 6))


MEANT = P + """, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), v AS (SELECT p.doc_id, p.posted_at, e.embedding::DOUBLE[] AS v FROM p, n, embeddings e WHERE e.vec_id = p.doc_id % n.n AND p.posted_at IS NOT NULL)"""


def meanings(spark, sf) -> DataFrame:
    """Postings with a time and a vector: those of the table, dealt in turn, so that some postings mean the same."""
    vectors = B.table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = vectors.agg((F.max("vec_id") + 1).alias("n"))
    p = postings(spark, sf).select("doc_id", "posted_at").crossJoin(F.broadcast(n))  # one row
    return p.withColumn("vec_id", F.col("doc_id") % F.col("n")).join(vectors, "vec_id").select("doc_id", "posted_at", "embedding")


@query(MEANT + " SELECT a.doc_id AS id, b.doc_id AS other_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.doc_id < b.doc_id AND abs(epoch(a.posted_at) - epoch(b.posted_at)) <= 14 * 86400 WHERE list_cosine_similarity(a.v, b.v) >= 0.92")
def semantic_matches(spark, sf):
    """All pairs of postings within fourteen days whose vectors' cosine is 0.92 or more."""
    return semantic.within_days(meanings(spark, sf), "posted_at", "doc_id").withColumn("similarity", F.round("similarity", 6))


@query()
def near_duplicate_pairs(spark, sf):
    """Links of distinct postings at 0.9 by their titles, companies and whole descriptions, and each posting with the one that it equals."""
    return neardup.pairs_with_members(B.headed(spark, sf), beginning=None)


@query()
def near_duplicates_kept(spark, sf):
    """Which postings the greedy pass keeps, by whole descriptions, and which kept one the others are most like."""
    return neardup.kept(B.headed(spark, sf), beginning=None)


@query()
def fuzzy_title_pairs(spark, sf):
    return dedup.fuzzy_with_members(postings(spark, sf))


@query(P + ", s AS (SELECT * FROM p WHERE is_active) SELECT doc_id FROM s WHERE external_id NOT IN (SELECT external_id FROM p WHERE NOT is_active)")
def incremental_new(spark, sf):
    p = postings(spark, sf)
    return dedup.without_known(p.where("is_active"), p.where("NOT is_active"), "external_id").select("doc_id")


# ---- enrichment


def count_sql(expr: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches(lower({expr}), {lit(p)})::INT" for p in patterns) + ")"


@query(f"SELECT page_id, {count_sql('substr(html, 1, 5000)', D.AUTH_CHALLENGES)} >= 2 AS is_wall FROM pages")
def auth_walls(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", E.auth_wall(F.col("html")).alias("is_wall"))


PHRASE_COUNT = lambda e: "(" + " + ".join(f"contains(lower({e}), {lit(p)})::INT" for p in D.ADAPTER_SPAM) + ")"
WORLD = f"({hits(TDL, D.WORLDWIDE)} OR {hits(TDL, D.HIRES_IN_INDIA)} OR ({hits(TDL, [r'\bremote\b'])} AND NOT {hits(TDL, D.LOCAL_ONLY)}) OR len(regexp_extract_all(lower({TDL}), {lit(D.ZONES)})) >= 2 OR len(regexp_extract_all(lower({TDL}), {lit(D.COUNTRIES)})) >= 3)"
KNOWN = "(" + " OR ".join(f"starts_with(lower(trim(company)), {lit(k)})" for k in D.KNOWN_COMPANIES) + ")"
LEGIT = f"({KNOWN} OR NOT {hits('company', D.SUSPICIOUS_NAMES)} AND NOT (NOT regexp_matches(description, '(?i)https?://\\S+') AND len(list_filter(string_split_regex(description, '\\s+'), lambda w: w <> '')) < 50) AND {count_sql('description', D.LEGITIMATE_SIGNALS)} >= 2)"
GUESS = case([(f"regexp_matches(lower({TDL}), {lit(p)})", lit(s)) for s, p in D.SENIORITY_PATTERNS], "'unknown'")
WHERE = case([(hits(TDL, [r"\bremote\b", r"\bworldwide\b", r"\banywhere\b", r"\bglobal\b"]), "'fully_remote'"), (hits(TDL, [r"\bhybrid\b"]), "'hybrid'")], "'unknown'")


@query(
    P
    + f"SELECT doc_id, round(least(1.0::DOUBLE, {PHRASE_COUNT('title')} * 0.25::DOUBLE + {PHRASE_COUNT('description')} * 0.15::DOUBLE), 4) AS spam, {WORLD} AS worldwide, {LEGIT} AS legitimate, CASE WHEN seniority <> 'unknown' THEN seniority ELSE {GUESS} END AS seniority, CASE WHEN remote_type <> 'unknown' THEN remote_type ELSE {WHERE} END AS remote_type, {count_sql(TDL, D.FAKE_SIGNALS)} >= 2 AS fake, title <> '' AND company <> '' AND url <> '' AS valid FROM p"
)
def enriched(spark, sf):
    t, d, c, l, u = (F.col(x) for x in ("title", "description", "company", "location", "url"))
    text = T.joined(t, d, l)
    return postings(spark, sf).select("doc_id", F.round(E.spam_score(t, d), 4).alias("spam"), E.hires_worldwide(t, d, l).alias("worldwide"), E.is_legitimate(c, d).alias("legitimate"), E.enriched_seniority(F.col("seniority"), text).alias("seniority"), E.enriched_remote(F.col("remote_type"), text).alias("remote_type"), E.looks_fake(text).alias("fake"), E.is_valid(t, c, u).alias("valid"))


@query()
def cv_match_analysis(spark, sf):
    m = matching.all_scores(cvs(spark, sf), matchable(spark, sf), texts=False)
    return m.select("cv_id", "doc_id", "score", E.match_band(F.col("score")).alias("band"))


@query(P + "SELECT source, count_if(salary <> '')::BIGINT AS paid, count(DISTINCT company) AS companies, count(DISTINCT date_trunc('month', posted_at)) AS months, max(posted_at) AS newest FROM p WHERE is_active GROUP BY 1")
def source_summary(spark, sf):
    return postings(spark, sf).where("is_active").groupBy("source").agg(F.count_if(F.col("salary") != "").alias("paid"), F.countDistinct("company").alias("companies"), F.countDistinct(F.date_trunc("month", "posted_at")).alias("months"), F.max("posted_at").alias("newest"))


@query("SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 5000 THEN 'pro' ELSE 'free' END AS plan, CASE WHEN max(o_orderdate) + INTERVAL 365 DAY >= TIMESTAMP '2001-08-02' THEN 'active' ELSE 'expired' END AS status, max(o_orderdate)::DATE + 365 AS expires FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal")
def subscription_status(spark, sf):
    last = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    ends = F.date_add(F.col("last").cast("date"), 365)
    until = F.col("last") + F.make_dt_interval(F.lit(365)) >= F.lit("2001-08-02 00:00:00").cast("timestamp_ntz")
    return B.table(spark, sf, "customer").join(last, "c_custkey").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 5000, "pro").otherwise("free").alias("plan"), F.when(until, "active").otherwise("expired").alias("status"), ends.cast("date").alias("expires"))
