"""More registered queries: stored jobs and their listing, dashboards, monitoring, clusters, boards' field rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import bindings as B
from postlake import dictionaries as D
from postlake import queries
from postlake.functions import landing, pages
from postlake.functions import text as T
from postlake.functions.enrich import match_band
from postlake.operators import analytics as A
from postlake.operators import clusters, dedup, matching, monitoring, semantic, titles
from postlake.operators.staging import staged
from postlake.plans import listing, ranking, records
from postlake.plans.listing import JobFilter
from postlake.queries import AUTHENTIC, COMPANY, DAILY, FIRM, FRESH, LEVEL, PAY, PLACE, REGION, SALARY_RANGE, SIZE, TAG, TDL, TITLE, TRUST, VERIFIED, P, R, applications, case, hits, holds, lit, postings, query, tagless_sql
from postlake.sources.readers import ingested

# ---- stored jobs


def stack_sql(expr: str) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {hits(expr, ps)} THEN {lit(n)} END" for n, ps in D.TECH.items()) + "], lambda x: x IS NOT NULL))"


BARE = lambda e: f"trim(regexp_replace(lower({e}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))"
GROUP = f"md5({BARE('title')} || '|' || {BARE('company')})"
STORED = f"""s AS (SELECT doc_id, external_id, source, trim(title) AS title, coalesce(nullif(trim(company), ''), 'Unknown') AS company, url, description, location, salary, array_to_string({stack_sql(TDL)}, ', ') AS tech_stack,
  {SIZE} AS company_size, {LEVEL} AS experience_level, {REGION} AS region_eligibility, {VERIFIED} AS is_verified_remote, {TAG} AS seniority_tag, {GROUP} AS duplicate_group_id, posted_at, scraped_at, is_active, seniority FROM p),
j AS (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY duplicate_group_id) AS is_duplicate FROM s)"""
J = P + ", " + STORED


def jobs(spark, sf) -> DataFrame:
    """Stored jobs with is_duplicate."""
    return records.stored_with_duplicates(postings(spark, sf))


STORED_COLUMNS = ["doc_id", "external_id", "title", "company", "tech_stack", "company_size", "experience_level", "region_eligibility", "is_verified_remote", "seniority_tag", "duplicate_group_id", "is_duplicate"]


@query(J + f" SELECT {', '.join(STORED_COLUMNS)} FROM j")
def stored_jobs(spark, sf):
    return jobs(spark, sf).select(*STORED_COLUMNS)


@query(
    P
    + f""", n AS (SELECT *, list_transform(regexp_extract_all(CASE WHEN contains(lower(salary), 'k') THEN regexp_replace(lower(trim(salary)), '[k$€£,]', '', 'g') ELSE lower(trim(salary)) END, '(\\d[\\d,]*)'), lambda n: replace(n, ',', '')::BIGINT * CASE WHEN contains(lower(salary), 'k') THEN 1000 ELSE 1 END) AS v, {stack_sql("description")} AS skills FROM p),
g AS (SELECT *, {case([(f"regexp_matches(lower(title), {lit(p)})", lit(s)) for s, p in D.SENIORITY_PATTERNS], "'unknown'")} AS level FROM n)
SELECT doc_id, CASE WHEN coalesce(list_min(v), 0) <> 0 THEN list_min(v) || '-' || CASE WHEN len(v) > 1 THEN list_max(v)::VARCHAR ELSE 'None' END || ' USD' ELSE '' END AS salary, CASE WHEN len(skills) > 0 THEN array_to_string(skills, ', ') END AS tech_stack, level AS experience_level, {VERIFIED} AS is_verified_remote FROM g"""
)
def stored_from_normalised(spark, sf):
    return records.stored_of_normalised(records.normalised(postings(spark, sf))).select("doc_id", "salary", "tech_stack", "experience_level", "is_verified_remote")


PAGE = "doc_id, title, company, posted_at FROM {} ORDER BY posted_at DESC NULLS LAST, scraped_at DESC, doc_id"


@query(J + " SELECT " + PAGE.format("j WHERE is_active AND contains(lower(source), 'remo') AND contains(lower(tech_stack), 'python') AND is_verified_remote AND NOT is_duplicate AND (contains(lower(title), 'engineer') OR contains(lower(company), 'engineer') OR contains(lower(description), 'engineer'))") + " LIMIT 50")
def list_jobs_search(spark, sf):
    f = JobFilter(is_active=True, source="remo", tech_stack="Python", is_verified_remote=True, is_duplicate=False, search="Engineer")
    return listing.listed(jobs(spark, sf), f).select("doc_id", "title", "company", "posted_at")


@query(J + " SELECT " + PAGE.format("j WHERE company_size = 'Mid-size' AND experience_level = 'Senior (excluded)' AND region_eligibility = 'Worldwide' AND seniority_tag = 'senior' AND doc_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')") + " LIMIT 25 OFFSET 5")
def list_jobs_page(spark, sf):
    f = JobFilter(company_size="Mid-size", experience_level="Senior (excluded)", region_eligibility="Worldwide", seniority_tag="senior", is_applied=False, is_sponsored=False, is_hot_job=False, offset=5, limit=25)
    return listing.listed(jobs(spark, sf), f, applications(spark, sf)).select("doc_id", "title", "company", "posted_at")


@query(J + ", top AS (SELECT doc_id FROM j WHERE is_active AND NOT is_duplicate AND posted_at >= TIMESTAMP '" + B.AS_OF + "' - INTERVAL 7 DAY ORDER BY posted_at DESC, doc_id LIMIT 20) SELECT doc_id, doc_id IN (SELECT doc_id FROM top) AS is_hot_job FROM j")
def hot_flags(spark, sf):
    """All flags set anew: true for the twenty newest of a week that are active and no repeats."""
    j = jobs(spark, sf)
    recent = j.where(F.col("is_active") & ~F.col("is_duplicate") & (F.col("posted_at") >= F.lit(B.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7))))
    top = dedup.top_by(recent, 20, F.desc("posted_at"), F.col("doc_id")).select("doc_id", F.lit(True).alias("hot"))
    return j.select("doc_id").join(F.broadcast(top), "doc_id", "left").select("doc_id", F.coalesce("hot", F.lit(False)).alias("is_hot_job"))


SEARCHES = {"python": JobFilter(tech_stack="Python", is_active=True), "remote devops": JobFilter(search="devops", is_verified_remote=True), "small firms": JobFilter(company_size="Startup")}
SEARCHED = {"python": "contains(lower(tech_stack), 'python') AND is_active", "remote devops": "is_verified_remote AND (contains(lower(title), 'devops') OR contains(lower(company), 'devops') OR contains(lower(description), 'devops'))", "small firms": "company_size = 'Startup'"}


@query(J + " " + " UNION ALL ".join(f"SELECT {lit(n)} AS search, count_if({c})::BIGINT AS matches, count_if(({c}) AND scraped_at > TIMESTAMP '{B.AS_OF}' - INTERVAL 3 DAY)::BIGINT AS fresh FROM j" for n, c in SEARCHED.items()))
def saved_searches(spark, sf):
    """What each saved search finds, and how much of it came in the last three days: all in one pass."""
    since = F.lit(B.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(3))
    hit = lambda f: F.coalesce(F.lit(True) if not listing.conditions(f) else F.expr("true") & all_of(listing.conditions(f)), F.lit(False))
    j = jobs(spark, sf)
    one = j.agg(*(F.struct(F.lit(n).alias("search"), F.count_if(hit(f)).alias("matches"), F.count_if(hit(f) & (F.col("scraped_at") > since)).alias("fresh")).alias(f"s{i}") for i, (n, f) in enumerate(SEARCHES.items())))
    return one.select(F.explode(F.array(*(f"s{i}" for i in range(len(SEARCHES))))).alias("s")).select("s.*")


def all_of(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# ---- dashboards


@query(
    J
    + f""", a AS (SELECT * FROM j WHERE is_active), k AS (SELECT DISTINCT o_custkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'total' AS dimension, 'all' AS name, count(*) AS n FROM a UNION ALL SELECT 'applied', 'all', count(*) FROM a JOIN k USING (doc_id)
UNION ALL SELECT 'new today', 'all', count_if(scraped_at >= TIMESTAMP '{B.AS_OF}')::BIGINT FROM a
UNION ALL SELECT 'tech', unnest(CASE WHEN tech_stack = '' THEN ['Unknown'] ELSE string_split(tech_stack, ', ') END), count(*) FROM a GROUP BY 2
UNION ALL SELECT 'size', company_size, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM a GROUP BY 2
UNION ALL SELECT 'day', d.day::VARCHAR, count(a.doc_id) FROM (SELECT unnest(generate_series(DATE '{B.AS_OF[:10]}' - 13, DATE '{B.AS_OF[:10]}', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN a ON coalesce(a.posted_at, a.scraped_at)::DATE = d.day GROUP BY 2"""
)
def job_stats(spark, sf):
    return A.stats(jobs(spark, sf), applications(spark, sf), B.AS_OF)


@query(
    J
    + """, a AS (SELECT * FROM j WHERE is_active)
SELECT source, count(*) AS total_scraped, count(*) AS total_matched, 100.0::DOUBLE AS match_rate, round(count_if(is_duplicate) * 100.0::DOUBLE / count(*), 2) AS duplicate_rate, round(count_if(is_verified_remote) * 100.0::DOUBLE / count(*), 2) AS verified_remote_rate, count_if(salary <> '')::BIGINT AS salary_data_available FROM a GROUP BY 1"""
)
def source_rates(spark, sf):
    return A.source_rates(jobs(spark, sf))


@query(J + ", a AS (SELECT source, round(count_if(is_verified_remote) * 100.0::DOUBLE / count(*), 2) AS r, count(*) AS n FROM j WHERE is_active GROUP BY 1) SELECT count(*) AS sources, round(avg(r), 1) AS average_verified, max_by(source, {'n': n, 's': source}) AS top_source FROM a")
def dashboard_totals(spark, sf):
    """Means over sources, each counting alike."""
    return A.source_rates(jobs(spark, sf)).agg(F.count("*").alias("sources"), F.round(F.avg("verified_remote_rate"), 1).alias("average_verified"), F.max_by("source", F.struct("total_scraped", "source")).alias("top_source"))


MID = f"m AS (SELECT *, coalesce((nullif(low, 0) + nullif(high, 0)) / 2.0::DOUBLE, nullif(low, 0)::DOUBLE, nullif(high, 0)::DOUBLE) AS mid FROM (SELECT j.*, {SALARY_RANGE} FROM j))"


@query(
    J
    + f""", {MID} SELECT 'seniority' AS dimension, seniority_tag AS name, count(*) AS n, round(avg(mid), 2) AS mean FROM m WHERE mid IS NOT NULL GROUP BY 2
UNION ALL SELECT 'region', region_eligibility, count(*), round(avg(mid), 2) FROM m WHERE mid IS NOT NULL GROUP BY 2 UNION ALL SELECT 'size', company_size, count(*), round(avg(mid), 2) FROM m WHERE mid IS NOT NULL GROUP BY 2
UNION ALL SELECT 'overall', 'all', count(*), round(avg(mid), 2) FROM m WHERE low > 0 AND high > 0"""
)
def salary_by_class(spark, sf):
    return A.salaries_by(jobs(spark, sf), {"seniority": "seniority_tag", "region": "region_eligibility", "size": "company_size"})


@query(
    J
    + f""", {MID.replace("m AS", "ms AS", 1)}, v AS (SELECT j.doc_id, j.posted_at, j.is_active, j.is_verified_remote AS verified, j.seniority FROM j), {DAILY}, a AS (SELECT * FROM j WHERE is_active)
SELECT 'source' AS section, source AS name, count(*)::DOUBLE AS value FROM a GROUP BY 2 UNION ALL SELECT 'verified rate', source, round(count_if(is_verified_remote) * 100.0::DOUBLE / count(*), 2) FROM a GROUP BY 2
UNION ALL SELECT 'region', region_eligibility, count(*)::DOUBLE FROM j GROUP BY 2 UNION ALL SELECT 'size', company_size, count(*)::DOUBLE FROM j GROUP BY 2 UNION ALL SELECT 'day', day::VARCHAR, n::DOUBLE FROM d
UNION ALL SELECT 'salary', seniority_tag, round(avg(mid), 2) FROM ms WHERE mid IS NOT NULL GROUP BY 2 UNION ALL SELECT 'tech', unnest(string_split(tech_stack, ', ')), count(*)::DOUBLE FROM j WHERE tech_stack <> '' GROUP BY 2"""
)
def dashboard(spark, sf):
    """The parts of the dashboard as one long table."""
    return A.overview(jobs(spark, sf), B.AS_OF)


@query(R + ", o AS (SELECT source, count(*) AS runs, count_if(NOT ok) AS failed FROM r WHERE run_id % 2 = 0 GROUP BY 1), n AS (SELECT source, count(*) AS runs, count_if(NOT ok) AS failed FROM r WHERE run_id % 2 = 1 GROUP BY 1) SELECT source, (coalesce(o.runs, 0) + coalesce(n.runs, 0))::BIGINT AS runs, (coalesce(o.failed, 0) + coalesce(n.failed, 0))::BIGINT AS failed FROM o FULL JOIN n USING (source)")
def source_metrics_incremented(spark, sf):
    """Stored counts by source with those of new runs added."""
    counted = lambda r: r.groupBy("source").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"))
    r = B.runs(spark, sf)
    return A.incremented(counted(r.where("run_id % 2 = 0")), counted(r.where("run_id % 2 = 1")), "source")


@query(J + " SELECT company, min_by(company_size, doc_id) AS company_size, bool_or(is_verified_remote) AS is_remote_friendly FROM j GROUP BY 1")
def company_profiles(spark, sf):
    return jobs(spark, sf).groupBy("company").agg(F.min_by("company_size", "doc_id").alias("company_size"), F.bool_or("is_verified_remote").alias("is_remote_friendly"))


@query(P + " SELECT doc_id, title, posted_at FROM p WHERE company = 'Stripe' AND is_active ORDER BY posted_at DESC NULLS LAST, doc_id LIMIT 20")
def company_jobs(spark, sf):
    return postings(spark, sf).where("company = 'Stripe' AND is_active").orderBy(F.desc_nulls_last("posted_at"), "doc_id").limit(20).select("doc_id", "title", "posted_at")


@query("SELECT c_name AS name, c_mktsegment AS industry FROM customer WHERE contains(lower(c_name), '#00000001') ORDER BY name LIMIT 20")
def company_search(spark, sf):
    return B.table(spark, sf, "customer").where(F.col("c_name").ilike("%#00000001%")).orderBy("c_name").limit(20).select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"))


@query(R + " SELECT run_id, source, ts, ok FROM r ORDER BY ts DESC, run_id DESC LIMIT 50")
def newest_runs(spark, sf):
    return B.runs(spark, sf).orderBy(F.desc("ts"), F.desc("run_id")).limit(50).select("run_id", "source", "ts", "ok")


@query("WITH b AS (SELECT p_partkey, p_name, p_size % 5 = 0 AS is_featured, p_retailprice = 0 AS is_free FROM part) SELECT p_partkey AS bundle_id, p_name AS name, is_featured FROM b ORDER BY is_featured DESC, name, bundle_id LIMIT 100")
def bundles_listed(spark, sf):
    """Featured bundles first, then by name."""
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("bundle_id"), F.col("p_name").alias("name"), (F.col("p_size") % 5 == 0).alias("is_featured")).orderBy(F.desc("is_featured"), "name", "bundle_id").limit(100)


@query("SELECT l_partkey AS bundle_id, count(*) AS purchases FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 5 = 0 GROUP BY 1 ORDER BY purchases DESC, bundle_id LIMIT 5")
def featured_bundles(spark, sf):
    sold = B.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("bundle_id")).agg(F.count("*").alias("purchases"))
    featured = B.table(spark, sf, "part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("bundle_id"))
    return sold.join(featured, "bundle_id", "left_semi").orderBy(F.desc("purchases"), "bundle_id").limit(5)


@query("""SELECT p_partkey AS path_id, '[{"t":"' || p_name || '","size":' || p_size || '}]' AS modules, p_size AS size FROM part ORDER BY p_size % 7 = 0 DESC, p_name, p_partkey LIMIT 100""")
def learning_paths(spark, sf):
    """Featured paths first, then by title; modules are kept as JSON, of which one number is read back."""
    p = B.table(spark, sf, "part").withColumn("modules", F.to_json(F.array(F.struct(F.col("p_name").alias("t"), F.col("p_size").alias("size")))))
    kind = "array<struct<t:string,size:int>>"
    return p.orderBy(F.desc(F.col("p_size") % 7 == 0), "p_name", "p_partkey").limit(100).select(F.col("p_partkey").alias("path_id"), "modules", F.from_json("modules", kind)[0]["size"].alias("size"))


@query("SELECT o_orderkey AS entry_id, o_orderdate AS since FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 7")
def owned_entries(spark, sf):
    """Entries of profiles, checked against who owns the profile."""
    owners = B.table(spark, sf, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return B.table(spark, sf, "orders").join(owners, "o_custkey").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("since"))


@query(P + ", c AS (SELECT *, is_active AND (seniority = 'unknown' OR remote_type = 'unknown') AS asks FROM p) SELECT asks, count(*) AS n FROM c GROUP BY 1")
def enrichment_candidates(spark, sf):
    """Postings that still lack a class, and the others: together all of them."""
    asks = F.col("is_active") & ((F.col("seniority") == "unknown") | (F.col("remote_type") == "unknown"))
    return postings(spark, sf).groupBy(asks.alias("asks")).agg(F.count("*").alias("n"))


@query(P + ", b AS (SELECT * FROM p WHERE doc_id % 2 = 0), n AS (SELECT * FROM p WHERE doc_id % 4 = 1 AND source <> 'elsewhere'), k AS (SELECT DISTINCT source FROM n) SELECT doc_id, source FROM b WHERE source NOT IN (SELECT source FROM k) UNION ALL SELECT doc_id, source FROM n")
def replaced_by_source(spark, sf):
    """Rows of the sources that come anew are replaced, all others stay."""
    p = postings(spark, sf).select("doc_id", "source")
    return A.replaced(p.where("doc_id % 2 = 0"), p.where("doc_id % 4 = 1 AND source <> 'elsewhere'"), "source")


# ---- scores and monitoring

WORDS = f"list_filter(string_split_regex(trim(title), '\\s+'), lambda w: w <> '')"
SPAM_TEXT = "(title || ' ' || company || ' ' || description)"
NUMBER = "try_cast(nullif(regexp_extract(salary, '(\\d+)', 1), '') AS DECIMAL(30, 0))"
SPAM = "least(1.0::DOUBLE, CASE WHEN length(regexp_replace(" + SPAM_TEXT + ", '[\\x00-\\x7F]', '', 'g')) > 5 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + " + " + ".join(f"CASE WHEN contains(lower({SPAM_TEXT}), {lit(p)}) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END" for p in D.SPAM_PHRASES) + f" + CASE WHEN {NUMBER} > 1000000 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {NUMBER} < 1 AND contains(lower(salary), 'hour') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len({WORDS}) > 0 AND len(list_filter({WORDS}, lambda w: upper(w) = w AND lower(w) <> w)) > len({WORDS}) * 0.5 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"
QUALITY = f"""greatest(0, least(10, 5.0::DOUBLE + CASE WHEN description = '' THEN -3.0::DOUBLE WHEN length(description) > 1000 THEN 2.0 WHEN length(description) > 500 THEN 1.5 WHEN length(description) > 200 THEN 1.0 WHEN length(description) < 100 THEN -2.0 ELSE 0.0 END
  + CASE WHEN trim(salary) = '' THEN -1.0::DOUBLE WHEN regexp_matches(salary, '\\d') THEN 1.5 + CASE WHEN contains(salary, '-') THEN 0.5 ELSE 0.0 END ELSE 0.0 END + CASE WHEN length(company) > 3 THEN 0.5::DOUBLE ELSE 0.0 END
  + CASE WHEN location <> '' AND lower(location) <> 'remote' THEN 0.5::DOUBLE WHEN trim(location) = '' THEN -1.0 ELSE 0.0 END + CASE WHEN url = '' THEN 0.0::DOUBLE WHEN regexp_matches(url, '^https?://') AND contains(url, '.') THEN 0.5 ELSE -1.0 END - {SPAM} * 2.0::DOUBLE))"""
PARTS = {"source_trust": TRUST, "freshness": FRESH, "quality": QUALITY, "company": FIRM, "remote_authenticity": AUTHENTIC, "salary_quality": PAY}
FINAL = "greatest(0, least(10, 0.0::DOUBLE + " + " + ".join(f"({'quality' if k == 'quality' else PARTS[k]}) * {w}::DOUBLE" for k, w in D.RANK_WEIGHTS.items()) + "))"
SCORED = f"q AS (SELECT *, {QUALITY} AS quality FROM p), c AS (SELECT *, {FINAL} AS final_score, {AUTHENTIC} AS authenticity, 1.0 - quality / 10.0::DOUBLE AS spam_indicator, {GROUP} AS duplicate_group_id FROM q), k AS (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY duplicate_group_id) AS is_duplicate FROM c)"
K = P + ", " + SCORED


def scored(spark, sf) -> DataFrame:
    """Postings with their ranking scores and is_duplicate."""
    p = ranking.ranked(postings(spark, sf), B.AS_OF).withColumn("duplicate_group_id", T.title_company_md5(F.col("title"), F.col("company")))
    return records.with_duplicates(p)


@query(K + " SELECT doc_id, round(final_score, 5) AS final_score, round(quality, 5) AS quality, CASE WHEN authenticity >= 9 THEN 'true-remote' WHEN authenticity >= 5 THEN 'hybrid' ELSE 'restricted' END AS remote_label, round(spam_indicator, 5) AS spam_indicator FROM k")
def ranking_scores(spark, sf):
    return scored(spark, sf).select("doc_id", F.round("final_score", 5).alias("final_score"), F.round("quality", 5).alias("quality"), "remote_label", F.round("spam_indicator", 5).alias("spam_indicator"))


STATISTICS = ", ".join(f"round({f}(final_score), 5) AS {n}" for f, n in (("avg", "mean"), ("min", "least"), ("max", "most")))


@query(K + f" SELECT source, count(*) AS n, {STATISTICS} FROM k GROUP BY ROLLUP (source)")
def ranking_statistics(spark, sf):
    """Count, mean, least and greatest score: of each source and of all (source null)."""
    s = F.col("final_score")
    return scored(spark, sf).rollup("source").agg(F.count("*").alias("n"), *(F.round(f(s), 5).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"))))


@query(K + f" SELECT posted_at::DATE AS day, source, count(*) AS n, count_if(is_duplicate)::BIGINT AS duplicates, count_if(spam_indicator > 0.5)::BIGINT AS spam, count_if(round(final_score, 6) > 7.0)::BIGINT AS high_quality, round(avg(final_score), 5) AS mean_score, round(avg(floor(epoch(TIMESTAMP '{B.AS_OF}' - posted_at) / 86400)), 5) AS mean_age_days, round(count_if(is_duplicate) * 100.0::DOUBLE / count(*), 2) AS duplicate_ratio, round(count_if(spam_indicator > 0.5) * 100.0::DOUBLE / count(*), 2) AS spam_ratio FROM k WHERE posted_at IS NOT NULL GROUP BY 1, 2")
def quality_view(spark, sf):
    return A.quality_view(scored(spark, sf), B.AS_OF)


@query(K + f", m AS (SELECT source AS source_name, max({TRUST}) AS trust FROM p GROUP BY 1), g AS (SELECT doc_id, final_score FROM k WHERE posted_at IS NOT NULL) SELECT k.doc_id, k.source, m.trust AS source_trust, round(g.final_score, 5) AS computed_score FROM k LEFT JOIN m ON k.source = m.source_name LEFT JOIN g ON g.doc_id = k.doc_id WHERE NOT is_duplicate AND spam_indicator < 0.5 AND scraped_at > TIMESTAMP '{B.AS_OF}' - INTERVAL 7 DAY")
def recent_quality_view(spark, sf):
    """Original postings of the last days that aren't spam, with their source's trust and, where they were scored, the score: two left joins."""
    s = scored(spark, sf)
    trust = s.groupBy(F.col("source").alias("source_name")).agg(F.max("source_trust").alias("trust"))
    scores = s.where("posted_at IS NOT NULL").select(F.col("doc_id").alias("job_id"), "final_score")
    recent = s.where(~F.col("is_duplicate") & (F.col("spam_indicator") < 0.5) & (F.col("scraped_at") > F.lit(B.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7)))).select("doc_id", "source")
    return recent.join(F.broadcast(trust), recent.source == trust.source_name, "left").join(scores, F.col("doc_id") == F.col("job_id"), "left").select("doc_id", "source", F.col("trust").alias("source_trust"), F.round("final_score", 5).alias("computed_score"))


@query(K + ", g AS (SELECT doc_id, final_score, quality FROM k WHERE posted_at IS NOT NULL) SELECT k.doc_id, k.title, round(g.final_score, 5) AS final_score, round(g.quality, 5) AS quality FROM k LEFT JOIN g USING (doc_id) WHERE NOT is_duplicate")
def quality_summary(spark, sf):
    s = scored(spark, sf)
    scores = s.where("posted_at IS NOT NULL").select("doc_id", F.round("final_score", 5).alias("final_score"), F.round("quality", 5).alias("quality"))
    return s.where("NOT is_duplicate").select("doc_id", "title").join(scores, "doc_id", "left")


FAILS = "f AS (SELECT source, count_if(NOT ok AND (good IS NULL OR {'ts': ts, 'run_id': run_id} > good))::BIGINT AS failures FROM r JOIN (SELECT source, max({'ts': ts, 'run_id': run_id}) FILTER (ok) AS good FROM r GROUP BY 1) g USING (source) GROUP BY 1)"
ALERTS = f"""{SCORED}, r AS ({B.RUNS}), {FAILS}, x AS (SELECT CASE WHEN failures >= 5 THEN 'error' WHEN failures >= 2 THEN 'warning' END AS severity, source, 'failures' AS kind, failures::DOUBLE AS value FROM f
UNION ALL SELECT CASE WHEN avg(is_duplicate::INT) > 0.5 THEN 'warning' END, source, 'duplicates', round(avg(is_duplicate::INT), 6) FROM k GROUP BY source
UNION ALL SELECT CASE WHEN count_if(scraped_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 7 DAY) = 0 THEN 'warning' END, 'system', 'no fresh jobs', count_if(scraped_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 7 DAY)::DOUBLE FROM k
UNION ALL SELECT CASE WHEN avg((spam_indicator > 0.5)::INT) FILTER (is_active) > 0.3 THEN 'warning' END, 'system', 'spam', round(avg((spam_indicator > 0.5)::INT) FILTER (is_active), 6) FROM k), al AS (SELECT * FROM x WHERE severity IS NOT NULL)"""


def alerts(spark, sf) -> DataFrame:
    s = scored(spark, sf)
    return monitoring.source_alerts(dedup.running_failures(B.runs(spark, sf)), s).unionByName(monitoring.system_alerts(s, B.AS_OF))


@query(P + ", " + ALERTS + " SELECT * FROM al")
def monitoring_alerts(spark, sf):
    return alerts(spark, sf)


@query(P + ", " + ALERTS + " SELECT severity, count(*) AS n FROM al GROUP BY 1")
def alert_breakdown(spark, sf):
    return monitoring.by_severity(alerts(spark, sf))


@query(P + ", " + ALERTS + " SELECT CASE WHEN count_if(severity = 'critical') > 0 THEN 'critical' WHEN count_if(severity = 'error') > 0 THEN 'degraded' ELSE 'healthy' END AS status, count(*) AS alert_count, count_if(severity = 'critical')::BIGINT AS critical_alerts, count_if(severity = 'error')::BIGINT AS error_alerts, count_if(severity = 'warning')::BIGINT AS warning_alerts FROM al")
def system_status(spark, sf):
    return monitoring.status(alerts(spark, sf))


@query(P + f", {SCORED}, r AS ({B.RUNS}) SELECT count(*) AS total_jobs, round(avg(is_duplicate::INT), 6) AS duplicate_ratio, round(avg(final_score) FILTER (final_score > 0), 5) AS avg_job_score, (SELECT count(DISTINCT source) FROM r WHERE ok)::BIGINT AS active_sources FROM k WHERE is_active")
def monitoring_gauges(spark, sf):
    g = monitoring.gauges(scored(spark, sf), B.runs(spark, sf).where("ok").select("source").distinct())
    return g.select("total_jobs", F.round("duplicate_ratio", 6).alias("duplicate_ratio"), F.round("avg_job_score", 5).alias("avg_job_score"), "active_sources")


@query(R + " SELECT run_id, source, ts FROM r WHERE NOT ok ORDER BY ts DESC, run_id DESC LIMIT 1000")
def alert_history(spark, sf):
    return monitoring.history(B.runs(spark, sf).where("NOT ok"), "ts", "run_id").select("run_id", "source", "ts")


@query(R + ", " + FAILS + ", w AS (SELECT source, max_by(event_type = 'signup', {'ts': ts, 'run_id': run_id}) AS enabled FROM r WHERE event_type IN ('signup', 'purchase') AND value > 80 GROUP BY 1) SELECT source, CASE WHEN enabled THEN 'healthy' WHEN NOT enabled THEN 'disabled' WHEN failures >= 5 THEN 'disabled' WHEN failures >= 2 THEN 'degraded' ELSE 'healthy' END AS status FROM f LEFT JOIN w USING (source)")
def source_switches(spark, sf):
    """States by failures, under the newest manual switch of a source (here events of high value stand for switches)."""
    r = B.runs(spark, sf)
    switches = r.where("event_type IN ('signup', 'purchase') AND value > 80").select("source", "ts", "run_id", (F.col("event_type") == "signup").alias("enabled"))
    return monitoring.switched(A.with_status(dedup.running_failures(r)), switches)


@query(P + f", r AS ({B.RUNS}), l AS (SELECT max(ts) AS last_at FROM r WHERE ok) SELECT last_at AS last_scrape_at, last_at > TIMESTAMP '{B.AS_OF}' - INTERVAL 5 HOUR AS is_fresh, round(epoch(TIMESTAMP '{B.AS_OF}' - last_at) / 3600.0::DOUBLE, 1) AS stale_in_hours, (SELECT count_if(is_active) FROM p)::BIGINT AS active_jobs_count FROM l")
def scrape_freshness(spark, sf):
    return monitoring.freshness(B.runs(spark, sf), postings(spark, sf), B.AS_OF, 5)


# ---- matches


@query()
def cv_match_counts(spark, sf):
    """Of each CV how many postings match, their mean score, and how many are strong or good."""
    s, n = F.col("score"), F.col("n")
    counts = matching.score_counts(queries.cvs(spark, sf), queries.matchable(spark, sf))
    some = lambda rule: F.coalesce(F.sum(F.when(rule, n)), F.lit(0))
    return counts.groupBy("cv_id").agg(F.sum("n").alias("n"), F.round(F.sum(s * n) / F.sum("n"), 4).alias("mean_score"), some(s >= 80).alias("strong"), some(s.between(50, 79)).alias("good"))


@query()
def matched_jobs(spark, sf):
    """The fifty best matches of a CV among the postings of two weeks."""
    since = f"posted_at >= TIMESTAMP_NTZ '{B.AS_OF}' - INTERVAL 14 DAY"
    recent = postings(spark, sf).where(since).select("doc_id", "title", "company")
    found = matching.all_scores(queries.cvs(spark, sf, "cv_id = 1"), queries.matchable(spark, sf, since), texts=False).select("doc_id", "score").join(recent, "doc_id")
    return found.orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", "title", "company", "score", match_band(F.col("score")).alias("band"))


# ---- clusters

PRIORITY = case([(f"source = {lit(k)}", str(v)) for k, v in D.CLUSTER_PRIORITY.items()], "0")
CLUSTERS = f"h AS (SELECT *, md5({TITLE} || '|' || {COMPANY} || '|' || {PLACE}) AS cluster_hash FROM k), cl AS (SELECT cluster_hash, max_by(doc_id, {{'p': {PRIORITY}, 'i': -doc_id}}) AS primary_id, count(*) AS size, count(*) - 1 AS duplicate_count FROM h GROUP BY 1 HAVING count(*) > 1)"


@query(K + f", {CLUSTERS} SELECT cluster_hash, primary_id, size, duplicate_count FROM cl")
def duplicate_clusters(spark, sf):
    return clusters.built(postings(spark, sf))


@query(K + f", {CLUSTERS} SELECT cluster_hash, duplicate_count, title, company, source FROM cl JOIN k ON k.doc_id = cl.primary_id")
def duplicate_summary(spark, sf):
    p = postings(spark, sf)
    return clusters.summary(clusters.built(p), p)


@query(K + f", {CLUSTERS}, mb AS (SELECT h.cluster_hash, h.doc_id FROM h JOIN cl USING (cluster_hash) WHERE h.doc_id <> cl.primary_id) SELECT cl.cluster_hash, count(mb.doc_id) + 1 AS total_duplicates, round(max(g.final_score), 5) AS best_score, array_to_string(list_sort(list(DISTINCT k.source)), ', ') AS source_list FROM cl LEFT JOIN mb USING (cluster_hash) LEFT JOIN k ON k.doc_id = mb.doc_id LEFT JOIN (SELECT doc_id, final_score FROM k WHERE posted_at IS NOT NULL) g ON g.doc_id = mb.doc_id GROUP BY 1")
def cluster_analysis(spark, sf):
    s = scored(spark, sf)
    c = clusters.built(s)
    return clusters.analysis(c, clusters.members(s, c), s, s.where("posted_at IS NOT NULL")).withColumn("best_score", F.round("best_score", 5))


@query()
def duplicate_cascade(spark, sf):
    """Matches of the distinct postings at the first of three levels: exact, fuzzy, then by their documents' vectors."""
    p = postings(spark, sf)
    meant = semantic.within_days(queries.meanings(spark, sf), "posted_at", "doc_id").select(F.col("id").alias("doc_id"), "other_id", "similarity")
    found = dedup.title_matches(p, dedup.fuzzy_least(0.85))
    return clusters.cascade(clusters.exact_of(found), dedup.fuzzy_of(found), meant)


@query()
def star_clusters(spark, sf):
    """Clusters around seeds by exact, fuzzy and semantic matches, all that reach their thresholds, older postings first and then the newer half with the stored seeds."""
    p = B.headed(spark, sf)
    meant = semantic.within_days(queries.meanings(spark, sf), "posted_at", "doc_id").select(F.col("id").alias("doc_id"), "other_id", "similarity")
    names = titles.all_matches(p)
    pairs = staged(clusters.edges(clusters.exact_of(names), dedup.fuzzy_of(names), meant), "edges")
    half = p.agg(F.expr("percentile_approx(doc_id, 0.5)").alias("half")).first().half or 0
    states, old = clusters.stars(pairs.where(F.col("b") < half))
    _, new = clusters.stars(pairs.where(F.col("b") >= half), states)
    return clusters.starred(old.unionByName(new), p)


# ---- rules for fields

LEGACY = lambda e: f"regexp_replace(lower({e}), '[^a-z0-9]', '', 'g')"


@query(P + f" SELECT doc_id, substr(sha256({LEGACY('title')} || '|' || {LEGACY('company')} || '|' || {LEGACY('substr(description, 1, 200)')}), 1, 16) AS legacy, replace({TITLE} || '|' || {COMPANY}, ' ', '_') AS cluster_key, array_to_string(list_sort(list_distinct(string_split({TITLE}, ' '))), ' ') AS tokens FROM p")
def older_signatures(spark, sf):
    t, c = F.col("title"), F.col("company")
    return postings(spark, sf).select("doc_id", T.legacy_signature(t, c, F.col("description")).alias("legacy"), clusters.cluster_key(t, c).alias("cluster_key"), F.array_join(F.array_sort(T.title_tokens(t)), " ").alias("tokens"))


@query(P + f" SELECT doc_id, {case([(f'contains(lower(title), {lit(k)})', lit(v)) for k, v in D.QUERY_ROLES.items()])} AS role, (length(trim(description)) < 50 OR lang = 'en') AS english, (contains(lower(title), 'devops') OR contains(lower(title), 'engineer')) AND ({holds('location', ['remote', 'anywhere', 'worldwide', 'global'])} OR location = '') AS fits FROM p")
def query_roles(spark, sf):
    t = F.col("title")
    return postings(spark, sf).select("doc_id", records.role_of_query(t).alias("role"), records.is_english(F.col("description"), F.col("lang")).alias("english"), records.title_fits(t, F.col("location"), "DevOps Engineer").alias("fits"))


FEED = ["company || ' | ' || title", "company || ' - ' || title", "company || ': ' || title", "title || ' at ' || company || ' Careers'", "company || '–' || title", "title", "'https://x.example: ' || title"]
FEEDS = P + ", t AS (SELECT *, " + "CASE " + " ".join(f"WHEN doc_id % {len(FEED)} = {i} THEN {e}" for i, e in enumerate(FEED)) + " END AS feed FROM p)"


def broken(mark: str, part: int) -> str:
    at = f"strpos(feed, {lit(mark)})"
    return f"trim(substr(feed, 1, {at} - 1))" if part == 0 else f"trim(substr(feed, {at} + {len(mark)}))"


def fits_sql(mark: str) -> str:
    more = f" AND NOT contains(lower({broken(mark, 0)}), 'http')" if mark == ":" else ""
    return f"strpos(feed, {lit(mark)}) > 0 AND length({broken(mark, 0)}) < 80 AND length({broken(mark, 1)}) > 5{more}"


BREAKS = [*D.TITLE_BREAKS, ":", "–"]
AT = "trim(substr(feed, strpos(feed, ' at ') + 4))"


@query(
    FEEDS
    + f""" SELECT doc_id, {case([(fits_sql(m), broken(m, 0)) for m in BREAKS], "''")} AS company, {case([(fits_sql(m), broken(m, 1)) for m in BREAKS], "feed")} AS title,
  CASE WHEN strpos(feed, ' at ') = 0 THEN 'Unknown' {' '.join(f"WHEN ends_with({AT}, {lit(x)}) THEN substr({AT}, 1, length({AT}) - {len(x)})" for x in D.BOARD_SUFFIXES)} ELSE {AT} END AS board_company FROM t"""
)
def feed_titles(spark, sf):
    p = postings(spark, sf).selectExpr("doc_id", "CASE " + " ".join(f"WHEN doc_id % {len(FEED)} = {i} THEN {e}" for i, e in enumerate(FEED)) + " END AS feed")
    named = landing.company_and_title(F.col("feed"))
    return p.select("doc_id", named["company"].alias("company"), named["title"].alias("title"), landing.title_at_company(F.col("feed"))["company"].alias("board_company"))


def first_sql(expr: str, patterns: list[str], group: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({expr}, {lit('(?i)' + p)}, {group}), '')" for p in patterns) + ", '')"


def pay_end(g: int) -> str:
    return "coalesce(" + ", ".join(f"floor(try_cast(replace(nullif(regexp_extract(salary, {lit('(?i)' + p)}, {g}), ''), ',', '') AS DOUBLE))::BIGINT" for p in D.PAY_RANGES) + ")"


PAY_ONE = f"floor(try_cast(replace(nullif(regexp_extract(salary, {lit('(?i)' + D.PAY_SINGLE)}, 1), ''), ',', '') AS DOUBLE))::BIGINT"


@query(
    P
    + f""", e AS (SELECT doc_id, salary, location, {pay_end(1)} AS a, {pay_end(2)} AS b, {PAY_ONE} AS o, description FROM p)
SELECT doc_id, CASE WHEN coalesce(a, 0) = 0 THEN coalesce(o, a) ELSE a END AS salary_min, CASE WHEN coalesce(a, 0) = 0 THEN coalesce(o, b) ELSE b END AS salary_max, {case([(f"contains(salary, {lit(k)})", lit(v)) for k, v in D.CURRENCIES.items()], "'USD'")} AS currency,
  {case([(holds("salary", ws), lit(n)) for n, ws in D.PAY_PERIODS], "'yearly'")} AS period, trim(string_split(location, ',')[1]) AS city, {case([(f"contains(lower(location), {lit(c)})", lit(c.title())) for c in D.PLACE_COUNTRIES], "''")} AS country, {case([(holds("location", ws), lit(n)) for n, ws in D.PLACE_TYPES], "'unknown'")} AS remote_type,
  {first_sql("salary", D.PAY_IN_TEXT, 0)} AS amount FROM e"""
)
def salary_and_place(spark, sf):
    s, l = landing.salary_details(F.col("salary")), landing.place_details(F.col("location"))
    return postings(spark, sf).select("doc_id", *(s[c].alias(c) for c in ("salary_min", "salary_max", "currency", "period")), *(l[c].alias(c) for c in ("city", "country", "remote_type")), landing.salary_in_text(F.col("salary")).alias("amount"))


@query(P + " SELECT doc_id, CASE WHEN trim(location) = '' THEN 'Remote' WHEN regexp_matches(lower(location), '\\b(remote|worldwide|anywhere|global)\\b') THEN trim(location) ELSE trim(location) || ' (Remote)' END AS place, 'google-' || substr(md5(url), 1, 12) AS short_id, CASE WHEN doc_id % 45 <= 1 THEN '1' WHEN doc_id % 45 <= 3 THEN '3' WHEN doc_id % 45 <= 7 THEN '7' WHEN doc_id % 45 <= 14 THEN '14' WHEN doc_id % 45 <= 30 THEN '30' END AS bucket, TIMESTAMP '" + B.AS_OF + "' - to_days((doc_id % 20)::INT) AS posted, '- ' || title || ' at ' || company || ' (' || CASE WHEN location = '' THEN 'Remote' ELSE location END || ')\n  Stack: Unknown\n  Apply: ' || url AS line FROM p")
def board_fields(spark, sf):
    age = F.concat(F.lit("Posted "), (F.col("doc_id") % 20).cast("string"), F.lit(" days ago"))
    return postings(spark, sf).select("doc_id", landing.remote_place(F.col("location")).alias("place"), landing.short_id("google", F.col("url")).alias("short_id"), landing.day_bucket(F.col("doc_id") % 45).alias("bucket"), landing.posted_by_age(age, B.AS_OF).alias("posted"), landing.alert_line(F.col("title"), F.col("company"), F.col("location"), F.lit(""), F.col("url")).alias("line"))


@query("SELECT event_id, (regexp_replace(regexp_replace(trim('```json\n' || props || '\n```'), '^```(?:json)?\\s*', ''), '\\s*```$', '')::JSON->>'k')::BIGINT AS k FROM events")
def fenced_json(spark, sf):
    return B.table(spark, sf, "events").select("event_id", F.from_json(landing.bare_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))), "k long")["k"].alias("k"))


@query(P + ", l AS (SELECT doc_id, list_filter(list_transform(string_split(title || ' ' || company || ' ' || title, ' '), lambda x: trim(x)), lambda x: x <> '') AS w FROM p) SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS words FROM l")
def words_once(spark, sf):
    return postings(spark, sf).select("doc_id", F.array_join(landing.once_each(F.split(F.concat_ws(" ", "title", "company", "title"), " ")), " ").alias("words"))


def page_sql(pattern: str) -> str:
    return f"regexp_extract(html, {lit(pattern)}, 1)"


def page_first(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ", '')"


@query(
    f"""WITH b AS (SELECT page_id, html, regexp_replace(html, {lit(pages.BOILERPLATE)}, ' ', 'g') AS bare FROM pages)
SELECT page_id, {page_first(page_sql(pages.meta_pattern("title")), tagless_sql(page_sql(pages.tag_pattern("h1"))))} AS title, {page_first(page_sql(pages.meta_pattern("description")), tagless_sql(page_sql(pages.class_pattern("description"))))} AS description,
  md5(coalesce({", ".join(f"CASE WHEN length({tagless_sql(f'regexp_extract(bare, {lit(pages.tag_pattern(t))}, 1)')}) > 100 THEN {tagless_sql(f'regexp_extract(bare, {lit(pages.tag_pattern(t))}, 1)')} END" for t in ("main", "article", "section", "body"))}, '')) AS text_md5 FROM b"""
)
def page_details(spark, sf):
    h = F.col("html")
    d = pages.job_details(h)
    return B.table(spark, sf, "pages").select("page_id", d["title"].alias("title"), d["description"].alias("description"), F.md5(pages.main_text(h)).alias("text_md5"))


@query(P + ", i AS (SELECT source, CASE WHEN title = '' OR company = '' OR doc_id % 13 = 0 THEN 'invalid' WHEN " + " + ".join(f"contains(lower(title), {lit(w)})::INT * 0.25::DOUBLE" for w in D.ADAPTER_SPAM) + " + " + " + ".join(f"contains(lower(description), {lit(w)})::INT * 0.15::DOUBLE" for w in D.ADAPTER_SPAM) + " > 0.1 THEN 'spam' ELSE 'kept' END AS outcome FROM p) SELECT source, count(*) AS fetched, count_if(outcome = 'invalid')::BIGINT AS invalid, count_if(outcome = 'spam')::BIGINT AS spam, count_if(outcome = 'kept')::BIGINT AS kept FROM i GROUP BY 1")
def ingest_counts(spark, sf):
    """What became of each source's records on their way in."""
    rows = ingested(postings(spark, sf).withColumn("url", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("url"))), 0.1)
    o = F.col("outcome")
    return rows.groupBy("source").agg(F.count("*").alias("fetched"), *(F.count_if(o == n).alias(n) for n in ("invalid", "spam", "kept")))
