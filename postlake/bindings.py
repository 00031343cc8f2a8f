"""The domain's tables, bound to the tables that a data folder has. Each comes as a DataFrame and as DuckDB SQL.

Postings come from documents: a posting's description is a phrase of a listing and the whole text of the document
after it; its short fields are chosen by the document's id from the lists below, so that every rule has rows that it
holds for. Queries that compare postings with each other take ``headed``, whose titles and texts are the documents'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
TITLES = ["Senior DevOps Engineer", "DevOps Engineer", "Junior Backend Developer", "Frontend Developer", "Office Manager", "Data Scientist", "Site Reliability Engineer", "QA Engineer II", "Sr. Platform Engineer", "Marketing Intern", "Full Stack Developer", "Security Analyst", "sr dev  remote role at the office"]
COMPANIES = ["Acme Inc.", "Globex GmbH", "Infosys Ltd", "Initech LLC", "Motorola Co", "Stripe", "Umbrella Corp.", "Hooli", "X", "Tiny startup"]
PHRASES = ["We run Kubernetes and Docker on AWS with Terraform. 3-5 years of experience. Fully remote, worldwide.", "Python and SQL on Linux, remote. 1-2 years.", "Hybrid role in the London office. Java and Spring, 5+ years.", "Earn money daily, contact us on telegram.", "US only. React and TypeScript, 2 years.", "No experience needed, urgent, immediate start today.", "Machine learning in Python, global team, 10 years and 3+ yrs.", "", "Based in Bangalore, India. Go and Rust.", "GraphQL, Redis and MongoDB. Work from anywhere, CI/CD with Jenkins."]
PLACES = ["Remote", "Berlin, Germany", "Hybrid - London", "Remote - United States", "", "Anywhere", "Remote, UTC hours"]
SALARIES = ["$80k - $120k", "", "50000 EUR per year", "$120k-$150k", "competitive", "$50,000 - $80,000", "100000-150000", "1500000 per hour"]
SOURCES = ["greenhouse", "remotive", "remoteok", "himalayas", "elsewhere"]
URLS = ["https://acme.example.org/jobs/", "https://www.linkedin.com/jobs/", "ftp//odd/", "HTTPS://Boards.example.com/J/"]
REMOTE_TYPES = ["fully_remote", "hybrid", "onsite", "unknown"]
SENIORITIES = ["intern", "junior", "mid_level", "senior", "lead", "unknown"]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(values: list[str], step: int = 1) -> str:
    """SQL (of both engines) for one of the values by id."""
    return "CASE " + " ".join(f"WHEN (doc_id // {step}) % {len(values)} = {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def spark_pick(values: list[str], step: int = 1):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(f"doc_id div {step}") % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return docs.select(
        "doc_id",
        F.concat(F.lit("ext-"), (F.col("doc_id") % 800).cast("string")).alias("external_id"),
        spark_pick(SOURCES, 3).alias("source"),
        spark_pick(TITLES).alias("title"),
        spark_pick(COMPANIES, 2).alias("company"),
        F.concat(spark_pick(URLS, 5), (F.col("doc_id") % 400).cast("string"), F.when(F.col("doc_id") % 3 == 0, "/?utm=1#top").otherwise("")).alias("url"),
        F.concat_ws(" ", spark_pick(PHRASES, 7), F.coalesce("text", F.lit(""))).alias("description"),
        spark_pick(PHRASES, 7).alias("phrase"),
        spark_pick(PLACES, 11).alias("location"),
        spark_pick(SALARIES, 13).alias("salary"),
        F.when(F.col("doc_id") % 17 != 0, F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("doc_id") % 45).cast("int"), hours=(F.col("doc_id") % 24).cast("int"))).alias("posted_at"),
        spark_pick(REMOTE_TYPES).alias("remote_type"),
        spark_pick(SENIORITIES, 3).alias("seniority"),
        (F.col("doc_id") % 10 != 0).alias("is_active"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("doc_id") % 9).cast("int"))).alias("scraped_at"),
        F.col("text").alias("body"),
        "lang",
    )


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings for the comparisons of postings with each other: the title is the document's first six words and the description its whole text, so both vary as the documents do and copies of documents are copies of postings; the company follows from the title."""
    words = F.filter(F.split(F.substring(F.coalesce("body", F.lit("")), 1, 200), r"\s+"), lambda w: w != "")
    p = postings(spark, sf_dir).drop("description", "phrase", "title", "company")
    p = p.withColumn("title", F.array_join(F.slice(words, 1, 6), " "))
    return p.withColumns({"company": F.element_at(F.array(*map(F.lit, COMPANIES)), (F.pmod(F.xxhash64("title"), F.lit(len(COMPANIES))) + 1).cast("int")), "description": F.coalesce("body", F.lit(""))}).drop("body")


POSTINGS = f"""SELECT doc_id, 'ext-' || (doc_id % 800) AS external_id, {pick(SOURCES, 3)} AS source, {pick(TITLES)} AS title, {pick(COMPANIES, 2)} AS company,
  {pick(URLS, 5)} || (doc_id % 400) || CASE WHEN doc_id % 3 = 0 THEN '/?utm=1#top' ELSE '' END AS url, {pick(PHRASES, 7)} || ' ' || coalesce(text, '') AS description, {pick(PHRASES, 7)} AS phrase,
  {pick(PLACES, 11)} AS location, {pick(SALARIES, 13)} AS salary,
  CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '{AS_OF}' - to_days((doc_id % 45)::INT) - to_hours(doc_id % 24) END AS posted_at,
  {pick(REMOTE_TYPES)} AS remote_type, {pick(SENIORITIES, 3)} AS seniority, doc_id % 10 <> 0 AS is_active, TIMESTAMP '{AS_OF}' - to_days((doc_id % 9)::INT) AS scraped_at, text AS body, lang
FROM documents WHERE doc_id IS NOT NULL"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sources: each event is a run of the source user_id, an error failed."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.concat(F.lit("src-"), (F.col("user_id") % 40).cast("string")).alias("source"), "ts", (F.col("event_type") != "error").alias("ok"), F.col("event_type"), "value")


RUNS = "SELECT event_id AS run_id, 'src-' || (user_id % 40) AS source, ts, event_type <> 'error' AS ok, event_type, value FROM events"
