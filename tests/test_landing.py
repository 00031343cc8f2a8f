"""Rules for the fields of single boards, pages and CVs, on golden rows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from postlake.functions import landing as L
from postlake.functions import pages, text
from postlake.plans import listing
from postlake.plans.criteria import Criteria
from postlake.sources import readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def struct(c):
    return F.to_json(c)


def test_titles_and_places(spark):
    split = lambda t: struct(L.company_and_title(F.lit(t)))
    got = one(spark, split("Acme | Senior Engineer"), split("Acme: Platform Engineer"), split("http://x: Platform Engineer"), split("Acme – Dev Lead"), split("Acme - x"), split("Engineer"))
    assert [json.loads(g)["company"] for g in got] == ["Acme", "Acme", "", "Acme", "", ""]
    assert json.loads(one(spark, struct(L.title_at_company(F.lit("Engineer at Acme Careers"))))[0]) == {"company": "Acme", "title": "Engineer"}
    tags = lambda *t: L.place_of_tags(F.array(*map(F.lit, t)))
    assert one(spark, tags("a", "UK only", "Remote"), tags("x", "Worldwide"), tags("x"), L.place_of_tags(F.lit(None).cast("array<string>"))) == ("UK only", "Remote", None, None)
    assert one(spark, L.remote_place(F.lit("· Berlin")), L.remote_place(F.lit(None).cast("string")), L.remote_place(F.lit("Anywhere"))) == ("Berlin (Remote)", "Remote", "Anywhere")
    assert one(spark, L.labelled(F.lit("x Location: Berlin Salary: 5k\nLocation: Rome"), "Location", "Salary"), L.labelled(F.lit("Salary: 5k\n"), "Salary")) == ("Berlin", "5k")


def test_records_of_boards(spark):
    assert one(spark, L.with_tags(F.lit("text"), F.array(F.lit("a"), F.lit(""), F.lit("b"))), L.with_tags(F.lit(None).cast("string"), F.array(F.lit("a"))), L.with_tags(F.lit("text"), F.lit(None).cast("array<string>"))) == ("text\nTags: a, b", "Tags: a", "text")
    address = F.struct(F.lit("Rome").alias("locality"), F.lit("").alias("region"), F.lit("IT").alias("country"))
    empty = F.struct(*(F.lit(None).cast("string").alias(n) for n in ("locality", "region", "country")))
    assert one(spark, L.nested_place(F.lit(""), address, F.lit(True)), L.nested_place(F.lit(""), empty, F.lit(True)), L.nested_place(F.lit("here"), address, F.lit(False))) == ("Rome, IT", "Remote", "here")
    names = F.array(F.struct(F.lit("A").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("B").alias("name")))
    sections = F.array(F.struct(F.lit("one").alias("text"), F.lit(None).cast("string").alias("content")), F.struct(F.lit("").alias("text"), F.lit("two").alias("content")))
    assert one(spark, L.names_joined(names), L.sections_text(sections), L.text_or_field(F.lit('{"name": "Rome"}'), "name"), L.text_or_field(F.lit("Rome"), "name")) == ("A, B", "one\ntwo\n", "Rome", "Rome")
    assert one(spark, L.currency_range(F.lit(5), F.lit(9), F.lit("EUR")), L.currency_range(F.lit(5), F.lit(None).cast("int"), F.lit("EUR")), L.currency_range(F.lit(0), F.lit(9), F.lit("EUR"))) == ("EUR 5 - 9", "EUR 5+", "")
    assert one(spark, L.relative_date(F.lit("posted 3 days ago by x")), L.day_bucket(F.lit(5)), L.day_bucket(F.lit(99))) == ("3 days ago", "7", None)
    assert str(one(spark, L.posted_by_age(F.lit("2 weeks ago"), "2024-01-31 00:00:00"))[0]) == "2024-01-17 00:00:00"
    post = json.loads(one(spark, struct(L.post_fields(F.lit("@acme is looking for a Cloud Engineer, London"))))[0])
    assert post == {"title": "Cloud Engineer", "company": "acme", "location": "London"}
    assert json.loads(one(spark, struct(L.post_fields(F.lit("Senior Developer wanted, wfh"))))[0]) == {"title": "Senior Developer", "location": "Remote"}


@pytest.mark.parametrize(("written", "want"), [("$50,000 - $80,000 a year", (50000, 80000, "USD", "yearly")), ("€40 per hour", (40, 40, "EUR", "hourly")), ("50k-80k", (50, 80, "USD", "yearly")), ("", (None, None, "USD", "yearly"))])
def test_salaries(spark, written, want):
    s = L.salary_details(F.lit(written))
    assert one(spark, *(s[c] for c in ("salary_min", "salary_max", "currency", "period"))) == want


def test_small_rules(spark):
    assert one(spark, L.salary_in_text(F.lit("pay $80k-120k now")), L.salary_in_text(F.lit("none")), L.bare_json(F.lit('```json\n{"a": 1}\n```'))) == ("$80k-120k", "", '{"a": 1}')
    assert one(spark, L.once_each(F.array(*map(F.lit, (" A", "a", "", "B", "b ")))))[0] == ["A", "B"]
    assert one(spark, L.form_key(F.lit("First name *"), F.lit("")), L.form_key(F.lit(""), F.lit("zip")), L.form_key(F.lit("?"), F.lit(""))) == ("firstname", "postalcode", None)
    assert one(spark, L.option_score(F.lit("United States"), F.lit("united states")), L.option_score(F.lit("States"), F.lit("United States")), L.option_score(F.lit("abc def"), F.lit("abc xyz")), L.option_score(F.lit("q"), F.lit("z"))) == (100.0, 80.0, 30.0, 0.0)
    assert one(spark, L.range_or_plus(F.lit("3-5 years"))["high"], L.range_or_plus(F.lit("5+ yrs"))["low"], L.range_or_plus(F.lit("4 years"))) == (5, 5, None)
    assert text.expanded_query("DevOps Engineer").startswith("DevOps Engineer ") and text.expanded_query("cook") == "cook"


def test_education(spark):
    cv = "Jane\nEducation\nBachelor of Arts, 2011\nMaster at Rome Institute\n2015\nSkills\nPython 2020"
    got = one(spark, L.education(F.lit(cv)))[0]
    assert [(e.degree, e.year, e.institution) for e in got] == [("bachelor", "2011", None), ("master", "2015", "Master at Rome Institute")]
    assert one(spark, L.education(F.lit("no school here")), L.education(F.lit(None).cast("string"))) == ([], [])


def test_pages(spark):
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Rome"}}], "datePosted": "2024-01-02"}</script>'
    plain = '<meta name="description" content="What we do"><h1>Lead <b>Dev</b></h1><div class="job-company x">Acme</div><p class="salary">5k</p><nav>menu</nav><main>' + "word " * 30 + "</main><table><tr><th>a</th><td>b</td></tr></table>"
    a, b = (json.loads(one(spark, struct(pages.job_details(F.lit(h))))[0]) for h in (ld, plain))
    assert (a["title"], a["company"], a["location"], a["posted_at"]) == ("Dev", "Acme", "Rome", "2024-01-02")
    assert (b["title"], b["company"], b["description"], b["salary"], b["location"]) == ("Lead Dev", "Acme", "What we do", "5k", "")
    assert one(spark, pages.main_text(F.lit(plain)), pages.table_rows(F.lit(plain)), pages.main_text(F.lit(None).cast("string"))) == (("word " * 30).strip(), [["a", "b"]], "")


def test_requests_and_parameters():
    f = listing.from_request({"search": "x", "region": "Worldwide", "is_duplicate": True, "limit": 5, "source": ""})
    assert f == listing.JobFilter(search="x", region_eligibility="Worldwide", limit=5)
    assert readers.source_parameters(Criteria(min_experience=0)) == {"query": "DevOps Engineer", "remote": True, "experience_min": 0, "posted_within_days": 14}


def test_landed_files(spark, tmp_path):
    for slug in ("acme", "globex"):
        (tmp_path / "fan").mkdir(exist_ok=True)
        (tmp_path / "fan" / f"{slug}.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "Dev", "absolute_url": f"https://{slug}/1", "content": "text", "location": {"name": "Rome"}}]}))
    got = sorted(readers.read_fan_out(spark, str(tmp_path / "fan"), "greenhouse").collect())
    assert [(r.source, r.company, r.title, r.location) for r in got] == [("greenhouse:acme", "acme", "Dev", "Rome"), ("greenhouse:globex", "globex", "Dev", "Rome")]

    (tmp_path / "g.json").write_text(json.dumps({"data": {"jobs": {"nodes": [{"id": "7", "name": None, "title": "Dev", "link": "https://x/7"}]}}}))
    r = readers.read_graphql(spark, str(tmp_path / "g.json"), "gql", "data.jobs.nodes", "id:string,name:string,title:string,link:string", {"external_id": ["id"], "title": ["name", "title"], "url": ["link"]}).first()
    assert (r.external_id, r.title, r.url) == ("gql-7", "Dev", "https://x/7")

    (tmp_path / "cards.html").write_text('<ul><li class="card"><a href="https://x/1">Dev <b>Lead</b></a><i>· Rome</i> 3 days ago</li><li class="card"><a href="">No link</a></li></ul>')
    r = readers.read_cards(spark, str(tmp_path / "cards.html"), "cards", r'(?s)<li class="card">.*?</li>', {"title": r"(?s)<a[^>]*>(.*?)</a>", "url": r'href="([^"]*)"', "location": r"<i>(.*?)</i>"}).collect()
    assert [(x.title, x.location, x.posted_at) for x in r] == [("Dev Lead", "Rome (Remote)", "3 days ago")]

    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Jane</w:t></w:r></w:p><w:p><w:r><w:t>5 years</w:t></w:r></w:p></w:document>')
    (tmp_path / "cv").mkdir()
    (tmp_path / "cv" / "a.docx").write_bytes(word.getvalue())
    (tmp_path / "cv" / "b.txt").write_text("plain")
    (tmp_path / "cv" / "c.pdf").write_bytes(b"%PDF")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in readers.read_cvs(spark, str(tmp_path / "cv")).collect()} == {"a.docx": "Jane\n5 years", "b.txt": "plain", "c.pdf": None}


def test_registry(spark, tmp_path):
    for name in ("remotive", "jobicy"):
        (tmp_path / name).mkdir()
    (tmp_path / "remotive" / "a.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "Dev", "url": "https://x/1"}, {"id": 1, "title": "Dev again", "url": "https://x/2"}]}))
    (tmp_path / "jobicy" / "a.json").write_text(json.dumps({"jobs": [{"id": 1, "jobTitle": "Ops", "url": "https://x/1"}]}))
    with pytest.warns(UserWarning, match="unknown source: nowhere"):
        got = readers.read_sources(spark, str(tmp_path), ["remotive", "jobicy", "nowhere"]).collect()
    assert sorted((r.external_id, r.title) for r in got) == [("jobicy-1", "Ops"), ("remotive-1", "Dev")]


def test_outcomes_are_observed(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([("Dev", "Acme", "u", "text"), ("", "Acme", "u", ""), ("bitcoin crypto mlm", "Acme", "u", "")], "title string, company string, url string, description string")
    seen = Observation("ingest")
    assert sorted(r.outcome for r in readers.observed(readers.ingested(rows), seen).collect()) == ["invalid", "kept", "spam"]
    assert seen.get == {"fetched": 3, "invalid": 1, "spam": 1, "kept": 1}


def test_a_field_that_is_an_object_or_a_text(spark):
    values = ['{"name": "Rome"}', "Rome", '{"name": ', "[1]", '{"x": 1}', '{"name": 7}', '"quoted"', "", None, "12"]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").orderBy("i").select(L.text_or_field(F.col("s"), "name").alias("v")).collect()]
    assert got == ["Rome", "Rome", '{"name": ', "[1]", "", "7", '"quoted"', "", "", "12"]
