"""Rules of single boards for the fields of their records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import dictionaries as D
from postlake.functions.classify import first_of
from postlake.functions.text import holds, text_or_empty


def with_tags(description: Column, tags: Column) -> Column:
    """The description with a line of tags under it, or that line alone; empty tags don't count."""
    named = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    line = F.concat(F.lit("Tags: "), F.array_join(named, ", "))
    text = text_or_empty(description)
    return F.when(F.size(named) == 0, text).when(text == "", line).otherwise(F.concat(text, F.lit("\n"), line))


def first_present(*values: Column) -> Column:
    """The first of several keys' values that isn't null or empty; empty text if none is."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values), F.lit(""))


def nested_place(own: Column, address: Column, remote: Column) -> Column:
    """A place as told, else the parts of a postal address (struct of locality, region, country), else Remote if the flag says so."""
    parts = F.array_compact(F.array(*(F.nullif(address[p], F.lit("")) for p in ("locality", "region", "country"))))
    return first_present(own, F.array_join(parts, ", "), F.when(remote, "Remote"))


def names_joined(items: Column, otherwise: str = "Remote") -> Column:
    """The names of a list of structs."""
    names = F.filter(F.transform(items, lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_join(names, ", ")).otherwise(otherwise)


def sections_text(sections: Column) -> Column:
    """The texts (or contents) of sections, a line each."""
    return F.array_join(F.transform(F.coalesce(sections, F.array().cast("array<struct<text:string,content:string>>")), lambda s: F.concat(first_present(s["text"], s["content"]), F.lit("\n"))), "")


def text_or_field(value: Column, field: str) -> Column:
    """A value that is JSON of an object or a plain text: the object's field as text (empty if it has none), else the text as it is, malformed JSON too. Read as a variant, so one column holds both kinds."""
    parsed = F.try_parse_json(value)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, text_or_empty(F.try_variant_get(parsed, f"$.{field}", "string"))).otherwise(text_or_empty(value))


def currency_range(low: Column, high: Column, currency: Column) -> Column:
    whole = lambda c: c.cast("long").cast("string")
    some = F.coalesce(low, F.lit(0)) != 0
    return F.when(some & (F.coalesce(high, F.lit(0)) != 0), F.concat_ws(" ", currency, whole(low), F.lit("-"), whole(high))).when(some, F.concat(currency, F.lit(" "), whole(low), F.lit("+"))).otherwise("")


def title_at_company(title: Column) -> Column:
    """Struct (company, title) of "title at company", without what boards add to a company's name."""
    at = F.instr(title, " at ")
    company = F.trim(F.substring(title, at + 4, F.length(title)))
    bare = company
    for suffix in reversed(D.BOARD_SUFFIXES):
        bare = F.when(company.endswith(suffix), F.substring(company, F.lit(1), F.length(company) - len(suffix))).otherwise(bare)
    return F.struct(F.when(at > 0, bare).otherwise("Unknown").alias("company"), F.when(at > 0, F.trim(F.substring(title, F.lit(1), at - 1))).otherwise(title).alias("title"))


def company_and_title(title: Column) -> Column:
    """Struct (company, title) by the first break that leaves a short company and a title: spaced marks in order, then a colon (not of a link), then a dash."""
    text = text_or_empty(title)
    rules = []
    for mark in [*D.TITLE_BREAKS, ":", "–"]:
        at = F.instr(text, mark)
        company = F.trim(F.substring(text, F.lit(1), at - 1))
        rest = F.trim(F.substring(text, at + len(mark), F.length(text)))
        fits = (at > 0) & (F.length(company) < 80) & (F.length(rest) > 5)
        rules.append((fits & ~F.lower(company).contains("http") if mark == ":" else fits, F.struct(company.alias("company"), rest.alias("title"))))
    out = F.struct(F.lit("").alias("company"), text.alias("title"))
    for rule, value in reversed(rules):
        out = F.when(rule, value).otherwise(out)
    return out


def place_of_tags(tags: Column) -> Column:
    """Remote, or the tag that names a region, by the first tag that tells either; null if none does."""
    far = lambda t: holds(t, ["remote", "worldwide", "global", "anywhere"])
    region = lambda t: holds(t, ["europe", "uk", "usa", "canada", "asia", "india"])
    told = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: far(t) | region(t))
    first = F.try_element_at(told, F.lit(1))
    return F.when(far(first), "Remote").otherwise(first)


def labelled(text: Column, label: str, stop: str | None = None) -> Column:
    """What follows "label:" up to the line's end or the next label."""
    found = F.regexp_extract(text_or_empty(text), rf"{label}:[^\S\n]*([^\n]*)", 1)
    return F.trim(F.substring_index(found, stop, 1) if stop else found)


def remote_place(place: Column) -> Column:
    """Without leading dots; Remote if there is none, and marked as remote unless it says so."""
    bare = F.trim(F.regexp_replace(text_or_empty(place), r"^[·\s]+", ""))
    return F.when(bare == "", "Remote").when(F.lower(bare).rlike(r"\b(remote|worldwide|anywhere|global)\b"), bare).otherwise(F.concat(bare, F.lit(" (Remote)")))


def relative_date(text: Column) -> Column:
    """ "N days ago" as text, the first in a card."""
    return F.regexp_extract(text_or_empty(text), r"(?i)(just now|\d+\s*(?:minute|hour|day|week|month)s?\s*ago)", 1)


def posted_by_age(text: Column, as_of: str) -> Column:
    """The time that a relative date means, counted back from ``as_of``; null if there is none."""
    age = relative_date(text)
    n = F.regexp_extract(age, r"(\d+)", 1).try_cast("int")
    days = F.when(F.lower(age).contains("day"), n).when(F.lower(age).contains("week"), n * 7).when(F.lower(age).contains("month"), n * 30)
    hours, minutes = F.when(F.lower(age).contains("hour"), n), F.when(F.lower(age).contains("minute"), n)
    zero = F.lit(0)
    now = F.lit(as_of).cast("timestamp_ntz")
    return F.when(age == "", None).otherwise(now - F.make_dt_interval(F.coalesce(days, zero), F.coalesce(hours, zero), F.coalesce(minutes, zero)))


def day_bucket(days: Column) -> Column:
    """The least of a board's ranges of days that holds so many; null beyond them."""
    return first_of([(days <= n, str(n)) for n in (1, 3, 7, 14, 30)])


def short_id(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.md5(text_or_empty(url)), 1, 12))


def post_fields(text: Column) -> Column:
    """Struct (title, company, location) of a free text: a title by three patterns or its first five words, the first @name or who is joined, a city or Remote."""
    t = text_or_empty(text)
    job = "Engineer|Developer|Manager"
    asked = F.regexp_extract(t, rf"(?i)(?:we are|hiring for|looking for|seeking)\s+(?:a\s+)?([A-Z][a-zA-Z\s]+(?:{job}|Designer|Analyst|Specialist))", 1)
    levelled = F.regexp_extract(t, rf"(?i)(?:Senior|Junior|Lead|Principal)\s+(?:[A-Z][a-zA-Z]+\s+)?(?:{job})", 0)
    kinds = F.regexp_extract(t, rf"(?i)(?:Software|Data|Product|Frontend|Backend|Full[- ]?Stack)\s+(?:{job})", 0)
    start = F.array_join(F.slice(F.filter(F.split(t, r"\s+"), lambda w: w != ""), 1, 5), " ")
    who = [F.regexp_extract(t, p, 1) for p in (r"@(\w+)", r"(?i)(?:at|@)\s+([A-Z][a-zA-Z\s]+)", r"(?i)(?:join|work for)\s+([A-Z][a-zA-Z\s]+)")]
    cities = [(F.lower(t).contains(c), c.title()) for c in ("san francisco", "new york", "london", "bangalore", "mumbai", "delhi")]
    place = F.when(holds(t, ["remote", "wfh", "work from home"]), "Remote").otherwise(first_of(cities, "Remote"))
    return F.struct(F.trim(first_present(asked, levelled, kinds, start)).alias("title"), F.trim(F.nullif(first_present(*who), F.lit(""))).alias("company"), place.alias("location"))


def salary_in_text(text: Column) -> Column:
    """The first amount or range of amounts with a currency, else the first range of plain numbers."""
    return first_present(*(F.regexp_extract(text_or_empty(text), f"(?i){p}", 0) for p in D.PAY_IN_TEXT))


def salary_details(text: Column) -> Column:
    """Struct (salary_min, salary_max, currency, period) by the first pattern with numbers; a single number is both ends."""
    t, low = text_or_empty(text), F.lower(text_or_empty(text))
    number = lambda p, g: F.floor(F.replace(F.regexp_extract(t, f"(?i){p}", g), F.lit(","), F.lit("")).try_cast("double")).cast("long")
    least, most = (F.coalesce(*(number(p, g) for p in D.PAY_RANGES)) for g in (1, 2))
    one = number(D.PAY_SINGLE, 1)
    alone = F.coalesce(least, F.lit(0)) == 0
    currency = first_of([(t.contains(k), v) for k, v in D.CURRENCIES.items()], "USD")
    period = first_of([(holds(low, words), name) for name, words in D.PAY_PERIODS], "yearly")
    return F.struct(F.when(alone, F.coalesce(one, least)).otherwise(least).alias("salary_min"), F.when(alone, F.coalesce(one, most)).otherwise(most).alias("salary_max"), currency.alias("currency"), period.alias("period"))


def place_details(text: Column) -> Column:
    """Struct (city, country, remote_type): the part before a comma, the first country whose name is a part of the text, and how work is done."""
    t = text_or_empty(text)
    kind = first_of([(holds(t, words), name) for name, words in D.PLACE_TYPES], "unknown")
    country = first_of([(F.lower(t).contains(c), c.title()) for c in D.PLACE_COUNTRIES], "")
    return F.struct(F.trim(F.substring_index(t, ",", 1)).alias("city"), country.alias("country"), kind.alias("remote_type"))


def bare_json(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text_or_empty(text)), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def range_or_plus(text: Column) -> Column:
    """Struct (low, high) of a range of years or of a number with a plus; null of neither."""
    low = F.lower(text_or_empty(text))
    span, plus = r"(\d{1,2})\s*[-–to]+\s*(\d{1,2})\s*(?:years?|yrs?)", r"(\d{1,2})\s*\+\s*(?:years?|yrs?)"
    at = lambda p, g: F.regexp_extract(low, p, g).try_cast("int")
    return F.when(low.rlike(span), F.struct(at(span, 1).alias("low"), at(span, 2).alias("high"))).when(low.rlike(plus), F.struct(at(plus, 1).alias("low"), F.lit(None).cast("int").alias("high")))


def once_each(items: Column) -> Column:
    """Items trimmed, without empty ones and those that repeat an earlier one but for case; the order stays."""
    bare = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    low = F.transform(bare, lambda x: F.lower(x))
    return F.filter(bare, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def alert_line(title: Column, company: Column, place: Column, stack: Column, url: Column) -> Column:
    """A posting as three lines of a message."""
    return F.format_string("- %s at %s (%s)\n  Stack: %s\n  Apply: %s", title, company, first_present(place, F.lit("Remote")), first_present(stack, F.lit("Unknown")), url)


def form_key(label: Column, name: Column) -> Column:
    """Which field of a profile a form's field asks for: the first whose words are in its label or name, compared without marks and spaces."""
    plain = lambda c: F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]", "")
    a, b = plain(label), plain(name)
    return first_of([(F.greatest(*(x.contains(w) for w in words for x in (a, b))), key) for key, words in D.FORM_FIELDS.items()])


def option_score(a: Column, b: Column) -> Column:
    """0 to 100: how well an option's text fits a value; 30 is enough to choose it."""
    x, y = F.lower(F.trim(text_or_empty(a))), F.lower(F.trim(text_or_empty(b)))
    wx, wy = F.split(x, r"\s+"), F.split(y, r"\s+")
    meet = lambda v, w: (F.length(v) > 2) & (F.length(w) > 2) & (v.contains(w) | w.contains(v))
    common = F.aggregate(wx, F.lit(0), lambda n, v: n + F.size(F.filter(wy, lambda w: meet(v, w))))
    return F.when(x == y, 100.0).when(x.contains(y) | y.contains(x), 80.0).otherwise(common / F.greatest(F.size(wx), F.size(wy)) * 60)


def education(text: Column) -> Column:
    """Array of (degree, year, institution) in the lines after an education heading, up to the next section. A line that names a school opens a section itself, so its name isn't read, which is the rule."""
    lines = F.split(text_or_empty(text), "\n")
    kind = "struct<degree:string,year:string,institution:string>"
    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("found"))
    entry = lambda d, y, i: F.struct(d.alias("degree"), y.alias("year"), i.alias("institution"))

    def step(s: Column, line: Column) -> Column:
        low = F.lower(F.trim(line))
        opens, closes = holds(low, D.EDUCATION_OPENS), holds(low, D.EDUCATION_CLOSES)
        degree = F.coalesce(*(F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in D.DEGREES), s["now"]["degree"])
        year = F.coalesce(F.nullif(F.regexp_extract(line, r"(?:19|20)\d{2}", 0), F.lit("")), s["now"]["year"])
        place = F.when(holds(low, ["institute"]), F.trim(line)).otherwise(s["now"]["institution"])
        whole = degree.isNotNull() & year.isNotNull()
        some = s["now"]["degree"].isNotNull() | s["now"]["year"].isNotNull() | s["now"]["institution"].isNotNull()
        same = F.struct(s["inside"].alias("inside"), s["now"].alias("now"), s["found"].alias("found"))
        opened = F.struct(F.lit(True).alias("inside"), s["now"].alias("now"), s["found"].alias("found"))
        closed = F.struct(F.lit(False).alias("inside"), F.lit(None).cast(kind).alias("now"), F.when(some, F.concat(s["found"], F.array(s["now"]))).otherwise(s["found"]).alias("found"))
        read = F.struct(F.lit(True).alias("inside"), F.when(whole, F.lit(None).cast(kind)).otherwise(entry(degree, year, place)).alias("now"), F.when(whole, F.concat(s["found"], F.array(entry(degree, year, place)))).otherwise(s["found"]).alias("found"))
        return F.when(opens, opened).when(s["inside"] & closes, closed).when(s["inside"], read).otherwise(same)

    return F.aggregate(lines, start, step, lambda s: s["found"])
