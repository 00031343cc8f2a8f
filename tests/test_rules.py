import datetime

import pytest
from pyspark.sql import functions as F

from postlake.functions import classify as C
from postlake.functions import numbers as N
from postlake.functions import text as T
from postlake.operators import dedup, matching, upsert
from postlake.plans import filters, ranking, scoring
from postlake.plans.criteria import Criteria
from postlake.sources import readers


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.v for r in rows.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_salaries(spark):
    got = values(spark, N.parse_salary, "$80k - $120k", "€50K", "$50,000 - $80,000", "$120k-$150k", "$85.5k", "competitive", None)
    assert [tuple(g) for g in got] == [(80000, 120000), (50000, None), (50000, 80000), (120000, 150000), (5000, 85000), (None, None), (None, None)]
    got = values(spark, N.salary_range, "$50,000 - $80,000", "50k-80k", "$120k-$150k", "100000-150000", "USD 90000 - 120000", "$80k", "€50,000 to €60,000", None)
    assert [tuple(g) for g in got] == [(50000, 80000), (50000, 80000), (None, None), (0, 150), (0, 120), (None, None), (50000, 60000), (None, None)]


def test_experience(spark):
    got = values(spark, N.experience_ranges, "3-5 years", "5+ years", "2 to 4 yrs", "10 years and 3+ yrs", None)
    assert [[tuple(r) for r in g] for g in got] == [[(3, 5), (5, 5)], [(5, None)], [(2, 4), (4, 4)], [(10, 10), (3, None)], []]


def test_dates(spark):
    got = values(spark, N.parse_datetime, "1704103200", "1704103200000", "2024-01-01T10:00:00+02:00", "Mon, 01 Jan 2024 10:00:00 +0000", "2024-01-01", "soon", None)
    ten, day = datetime.datetime(2024, 1, 1, 10), datetime.datetime(2024, 1, 1)
    assert got == [ten, ten, ten, ten, day, None, None]
    [d] = values(spark, lambda x: N.days_between(F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), x.cast("timestamp_ntz")), "2024-01-03 12:00:00")
    assert d == -2


def test_hashes(spark):
    [h] = spark.range(1).select(F.md5(F.concat_ws("|", F.lit("a"), F.lit("b"))).alias("m"), T.near_id(F.lit("a"), F.lit("b")).alias("s")).collect()
    assert (h.m, h.s) == ("d0726241020676b14aa6298ce6a18b21", "0eab8a0a3380abf4")


def posting(spark, **fields):
    base = {"doc_id": 1, "title": "Engineer", "company": "Acme", "description": "", "location": "", "remote_type": "unknown", "seniority": "unknown", "source": "x", "url": "https://a.b/c", "salary": ""} | fields
    kinds = {"doc_id": "long", "experience_min": "int", "experience_max": "int", "salary_min": "long", "salary_max": "long"}
    row = base | {k: base.get(k) for k in ("experience_min", "experience_max", "salary_min", "salary_max", "posted_at")} | {k: [] for k in ("skills", "tags", "requirements", "responsibilities")}
    schema = ", ".join(f"{k} {'array<string>' if v == [] else 'timestamp_ntz' if k == 'posted_at' else kinds.get(k, 'string')}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(("title", "score"), [("DevOps Engineer", 1.0), ("Senior DevOps Engineer", 1.0), ("Site Reliability Engineer", 0.8), ("Frontend Developer", 0.4), ("Office Manager", 0.0)])
def test_title_scores(spark, title, score):
    [r] = scoring.relevance(posting(spark, title=title), Criteria()).collect()
    assert r.s_title == score


@pytest.mark.parametrize(("low", "high", "score"), [(3, 4, 1.0), (4, 7, None), (10, 15, 0.0)])
def test_experience_scores(spark, low, high, score):
    [r] = scoring.relevance(posting(spark, experience_min=low, experience_max=high), Criteria(min_experience=2, max_experience=5, strict_experience=True)).collect()
    assert r.s_experience == score if score is not None else r.s_experience > 0.5


def test_overall_score_and_cascade(spark):
    good = posting(spark, title="DevOps Engineer", description="Kubernetes on AWS, remote, 3-4 years", experience_min=3, experience_max=4, remote_type="fully_remote", location="Remote")
    [r] = scoring.relevance(good, Criteria(min_experience=2, max_experience=5)).collect()
    assert 0.5 < r.relevance_score <= 1
    reason = lambda **f: posting(spark, **f).select(filters.reject_reason(Criteria(max_experience=f.pop("top", None)))).first()[0]
    assert filters.passing(good, Criteria()).count() == 1
    assert reason(title="DevOps Engineer", description="join our telegram") == "fake"
    assert reason(title="Cook", description="soup") == "query"
    assert reason(title="DevOps Engineer", description="hybrid", location="Paris") == "not remote"
    assert reason(title="DevOps Engineer", description="remote", company="Motorola") == "company"
    assert reason(title="DevOps Engineer", description="remote", location="Pune") == "place"


def test_classes(spark):
    one = lambda f, *a: spark.range(1).select(f(*(F.lit(x) for x in a))).first()[0]
    assert one(C.experience_level, "Junior Senior Engineer", "") == "Junior (0-2 years)"
    assert one(C.seniority_tag, "Junior Senior Engineer", "") == "senior"
    assert one(C.role_category, "SRE", "frontend developer") == "devops"
    assert one(C.role_category, "Cook", "frontend developer") == "frontend"
    assert one(C.tech_stack, "Python, c# dev and K8s") == ["Kubernetes", "Python"]
    assert one(C.region, "Pune, India", "") == "India Eligible"
    assert one(C.verified_remote, "Remote", "hybrid work", "") is False


def test_ranking(spark):
    [r] = ranking.ranked(posting(spark, source="Greenhouse", salary="$100k-$150k", location="Remote", description="x" * 1200), "2024-01-31 00:00:00").collect()
    assert (r.source_trust, r.freshness, r.salary_quality, r.remote_authenticity, r.remote_label) == (10.0, 5.0, 9.0, 10.0, "true-remote")
    rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate([5, 9, 5, 1])], "doc_id long, final_score double")
    got = [(x.doc_id, x["rank"], x.percentile) for x in ranking.with_percentile(rows).orderBy("rank").collect()]
    assert got == [(1, 1, 100.0), (0, 2, 75.0), (2, 3, 50.0), (3, 4, 25.0)]


def test_dedup(spark):
    rows = spark.createDataFrame([(1, "e1", "A Dev", "Acme", "u/1?x"), (2, "e1", "B", "Acme", "v"), (3, "e3", "a dev!", "ACME", "U/1/")], "doc_id long, external_id string, title string, company string, url string")
    assert sorted(r.doc_id for r in dedup.exact(rows).collect()) == [1, 3]
    scored = rows.withColumn("relevance_score", F.when(F.col("doc_id") == 3, 0.9).otherwise(0.5))
    assert sorted(r.doc_id for r in dedup.by_signature(scored).collect()) == [2, 3]


def test_ratios(spark):
    pair = spark.createDataFrame([("senior data engineer", "data engineer senior"), ("abc", "abd"), ("", "x")], "a string, b string")
    got = [tuple(r) for r in pair.select(dedup.token_set("a", "b"), dedup.indel("a", "b"), dedup.ratio("a", "b")).collect()]
    assert got[0][0] == 1.0 and got[1][1] == pytest.approx(2 * 2 / 6) and got[2] == (0.0, 0.0, 0.0)


def test_upsert(spark):
    kind = "k string, a string, n int, seq int"
    old, new = spark.createDataFrame([("x", "old", 1, 0), ("y", "keep", 2, 0)], kind), spark.createDataFrame([("x", "", 0, 1), ("x", "second", 9, 2), ("z", "new", 3, 3)], kind)
    got = sorted((r.k, r.a, r.n) for r in upsert.merged(old, new, "k", "seq").collect())
    assert got == [("x", "old", 0), ("y", "keep", 2), ("z", "new", 3)]
    rows = spark.createDataFrame([("x", True), ("y", False)], "k string, is_active boolean")
    assert sorted((r.k, r.is_active) for r in upsert.activated(rows, rows.where("k = 'y'"), "k").collect()) == [("x", False), ("y", True)]
    assert sorted((r.k, r.is_active) for r in upsert.activated(rows, rows.limit(0), "k").collect()) == [("x", True), ("y", False)]


def test_matching(spark):
    cvs = spark.createDataFrame([(1, ["python", "sql"], 4)], "cv_id int, skills array<string>, years int")
    jobs = spark.createDataFrame([(1, "Data Engineer", "python and sql, git, 3-5 years", ["python", "sql"], "mid", True), (2, "Cook", "", ["soup"], "mid", False)], "doc_id long, title string, description string, tech array<string>, seniority_tag string, verified boolean")
    [r] = matching.scores(cvs, jobs).collect()
    assert (r.doc_id, r.matched, r.missing) == (1, "python,sql", "git") and 60 <= r.score <= 100


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs": [{"id": 7, "title": "Dev", "company_name": "Acme", "url": "u", "description": "<p>d</p>", "candidate_required_location": "Worldwide", "salary": "", "publication_date": "2024-01-01"}]}')
    [r] = readers.read_json(spark, str(tmp_path / "a.json"), "remotive").collect()
    assert (r.external_id, r.company, r.location, r.posted_at) == ("remotive-7", "Acme", "Worldwide", "2024-01-01")
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme: Developer</title><link>u</link><description>&lt;b&gt;hi&lt;/b&gt; there</description><category>Remote</category><category>x</category></item></channel></rss>")
    [r] = readers.read_rss(spark, str(tmp_path / "f.xml"), "feed").collect()
    assert (r.company, r.description, r.location) == ("Acme", "hi there", "Remote") and len(r.external_id) == 32
    (tmp_path / "p.html").write_text("<html><head><title> A  page </title><script>x()</script></head><body>Text &amp; more</body></html>")
    [r] = readers.read_pages(spark, str(tmp_path / "p.html"), "web").collect()
    assert (r.title, r.description) == ("A page", "A page Text & more")
    [r] = readers.read_comments(spark.createDataFrame([("Acme | Dev | Berlin\nnothing",)], "body string"), "hn").collect()
    assert (r.company, r.title, r.location) == ("Acme", "Dev", "Berlin")


def test_enrichment(spark):
    from postlake.functions import enrich as E

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(E.cv_years(F.lit("Engineer with 2.5+ years of professional experience"))) == 2
    assert one(E.cv_years(F.lit("total experience: 7 years"))) == 7
    assert one(E.mentioned(F.lit("AWS Certified, Scrum Master"), ["aws certified", "scrum master", "pmp"])) == ["aws certified", "scrum master"]
    assert one(E.auth_wall(F.lit("<h1>Please log in</h1> solve the captcha"))) is True
    assert one(E.auth_wall(F.lit("jobs"), F.lit(403))) is True
    assert one(E.job_type(F.lit("Full-Time "))) == "full_time"
    assert one(E.experience_fit(F.lit(4), F.lit(3), F.lit(5))) == "high"
    assert one(E.experience_fit(F.lit(1), F.lit(5), F.lit(8))) == "low"
    assert one(E.is_legitimate(F.lit("Stripe"), F.lit(""), ["stripe"])) is True
