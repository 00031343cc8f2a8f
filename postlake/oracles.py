"""DuckDB SQL of the scoring queries, which is longer than theirs beside them."""

from __future__ import annotations

from postlake import bindings as B
from postlake import dictionaries as D
from postlake.operators import matching
from postlake.queries import CVS, LD, LEVEL, REASON, REGION, RELEVANT, ROLE, STACK, TAG, TD, URL, VERIFIED, NORMAL, ORACLES, P, Q, case, holds, lit, terms_in
from postlake.views import AUTHENTIC, FINAL, QUALITY

SPAN, PLUS, SINGLE = "(\\d{1,2})\\s*[-–to]+\\s*(\\d{1,2})\\s*(?:years?|yrs?)", "(\\d{1,2})\\s*\\+\\s*(?:years?|yrs?)", "(\\d{1,2})\\s*(?:years?|yrs?)"
D_LOW = "lower(description)"


def at(pattern: str, group: int) -> str:
    return f"try_cast(nullif(regexp_extract({D_LOW}, '{pattern}', {group}), '') AS INT)"


NEED_LOW = case([(f"regexp_matches({D_LOW}, '{SPAN}')", at(SPAN, 1)), (f"regexp_matches({D_LOW}, '{PLUS}')", at(PLUS, 1)), (f"{at(SINGLE, 1)} <= 20", at(SINGLE, 1))])
NEED_HIGH = case([(f"regexp_matches({D_LOW}, '{SPAN}')", at(SPAN, 2)), (f"regexp_matches({D_LOW}, '{PLUS}')", "NULL"), (f"{at(SINGLE, 1)} <= 20", at(SINGLE, 1))])
NEEDED = case([(f"regexp_matches({D_LOW}, '{SPAN}')", "true"), (f"regexp_matches({D_LOW}, '{PLUS}')", "true"), (f"{at(SINGLE, 1)} <= 20", "true")], "false")

NUMBERS = "list_transform(regexp_extract_all(CASE WHEN contains(lower(salary), 'k') THEN regexp_replace(lower(trim(salary)), '[k$€£,]', '', 'g') ELSE lower(trim(salary)) END, '(\\d[\\d,]*)'), lambda n: replace(n, ',', '')::BIGINT * CASE WHEN contains(lower(salary), 'k') THEN 1000 ELSE 1 END)"
DETAILED = f"x AS (SELECT *, {NUMBERS} AS v, {STACK} AS skills, {NEED_LOW} AS need_low, {NEED_HIGH} AS need_high, {NEEDED} AS needed FROM p), d AS (SELECT *, list_min(v) AS salary_min, CASE WHEN len(v) > 1 THEN list_max(v) END AS salary_max, coalesce(nullif(need_low, 0), 0) AS low, coalesce(nullif(need_high, 0), 99) AS high, floor(epoch(TIMESTAMP '{B.AS_OF}' - posted_at) / 86400)::BIGINT AS age FROM x)"

LEAST, MOST, DAYS = Q.min_experience, Q.max_experience, Q.posted_within_days
TITLE_SHARE, TEXT_SHARE = (f"({terms_in(e)} / {float(len(Q.terms))}::DOUBLE)" for e in ("title", TD))
SCORES = {
    "title": case([(f"lower(title) = {lit(Q.query.lower())}", "1.0::DOUBLE"), (f"{TITLE_SHARE} = 1", "1.0::DOUBLE"), (f"{TITLE_SHARE} > 0", TITLE_SHARE), (f"coalesce({ROLE} = {lit(Q.role)}, false)", "0.8::DOUBLE"), (RELEVANT, "0.4::DOUBLE")], "0.0::DOUBLE"),
    "description": case([("description = ''", "0.5::DOUBLE"), (f"{TEXT_SHARE} = 0", "0.0::DOUBLE")], f"least(1.0::DOUBLE, {TEXT_SHARE} + 0.2::DOUBLE)"),
    "experience": f"CASE WHEN low <= {MOST} AND high >= {LEAST} THEN CASE WHEN low >= {LEAST} AND high <= {MOST} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (least(high, {MOST}) - greatest(low, {LEAST}))::DOUBLE / greatest(CASE WHEN high <> low THEN high - low ELSE 1 END, {MOST - LEAST}) + 0.3::DOUBLE) END WHEN low <= {MOST + 1} AND high >= {LEAST - 1} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END",
    "seniority": "1.0::DOUBLE",
    "location": case([("remote_type = 'fully_remote'", "1.0::DOUBLE"), ("remote_type = 'hybrid'", "0.5::DOUBLE"), ("remote_type = 'onsite'", "0.0::DOUBLE"), (holds(LD, ["remote", "worldwide", "anywhere", "global"]), "0.8::DOUBLE"), (holds(LD, ["onsite", "on-site", "in office", "hybrid"]), "0.3::DOUBLE")], "0.5::DOUBLE"),
    "freshness": case([("posted_at IS NULL OR age <= 0", "1.0::DOUBLE"), (f"age <= {DAYS}", f"1.0::DOUBLE - age / {float(DAYS)}::DOUBLE * 0.5::DOUBLE"), (f"age <= {2 * DAYS}", "0.3::DOUBLE")], "0.0::DOUBLE"),
    "quality": "round(least(1.0::DOUBLE, CASE WHEN length(description) >= 500 THEN 0.2::DOUBLE WHEN length(description) >= 200 THEN 0.15 WHEN length(description) >= 100 THEN 0.1 WHEN length(description) >= 50 THEN 0.05 ELSE 0.0 END + CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN CASE WHEN salary_max > salary_min THEN 0.25::DOUBLE ELSE 0.15 END WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN 0.1 ELSE 0.0 END + CASE WHEN len(skills) >= 3 THEN 0.2::DOUBLE WHEN len(skills) >= 1 THEN 0.12 ELSE 0.0 END + CASE WHEN trim(location) <> '' THEN 0.05::DOUBLE ELSE 0.0 END + CASE WHEN seniority <> 'unknown' THEN 0.05::DOUBLE ELSE 0.0 END), 2)",
}
TOTAL = "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.0::DOUBLE + " + " + ".join(f"s_{k} * {w}::DOUBLE" for k, w in D.RELEVANCE_WEIGHTS.items()) + ")), 3)"
RELEVANCE = f"{DETAILED}, s AS (SELECT *, {', '.join(f'{SCORES[k]} AS s_{k}' for k in D.RELEVANCE_WEIGHTS)} FROM d), t AS (SELECT *, {TOTAL} AS relevance_score FROM s)"

ORACLES["relevance_scores"] = P + f", {RELEVANCE} SELECT doc_id, {', '.join(f's_{k}' for k in D.RELEVANCE_WEIGHTS)}, relevance_score FROM t"
ORACLES["relevance_pipeline"] = P + f", {RELEVANCE}, f AS (SELECT *, {NORMAL('title')} || '|' || {NORMAL('company')} || '|' || {URL} AS signature FROM t WHERE ({REASON}) IS NULL), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY signature ORDER BY relevance_score DESC, doc_id) = 1) SELECT doc_id, title, source, relevance_score FROM b WHERE relevance_score >= 0.3 ORDER BY relevance_score DESC, doc_id LIMIT 500"
ORACLES["ranking_percentile"] = P + f", q AS (SELECT *, {QUALITY} AS quality FROM p), c AS (SELECT doc_id, source, round({FINAL}, 6) AS final_score, CASE WHEN {AUTHENTIC} >= 9 THEN 'true-remote' WHEN {AUTHENTIC} >= 5 THEN 'hybrid' ELSE 'restricted' END AS remote_label, 1.0 - quality / 10.0::DOUBLE AS spam_indicator FROM q), n AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, doc_id) AS rank, count(*) OVER () AS total FROM c) SELECT doc_id, source, final_score, remote_label, spam_indicator, rank, (total - rank + 1) * 100.0::DOUBLE / total AS percentile FROM n"


def strings(xs) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]::VARCHAR[]"


TOKENS = lambda e: f"list_distinct(regexp_extract_all({e}, '([a-zA-Z0-9+#.]+)', 1))"
CV_ROWS = "cv AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {strings(s)}, {strings(r)}, {'NULL' if y is None else y}::INT, []::VARCHAR[])" for i, s, r, y in CVS) + f") t(cv_id, skills, roles, years, keywords) UNION ALL SELECT doc_id, list_transform({STACK}, lambda s: lower(s)), [lower(title)], CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 13)::INT END, list_sort(list_distinct(regexp_extract_all(lower(coalesce(body, '')), '[a-z]{{6,}}')))[1:10] FROM p WHERE doc_id % 100 = 0)"
ONE_ROLE = f"CASE WHEN len(list_intersect({TOKENS('r')}, {TOKENS('lower(title)')})) > 0 THEN (CASE WHEN contains(lower(title), r) THEN 1.0::DOUBLE ELSE len(list_intersect({TOKENS('r')}, {TOKENS('lower(title)')}))::DOUBLE / len({TOKENS('r')}) END) * (0.3::DOUBLE + 0.7::DOUBLE * (len(list_filter(list_intersect({TOKENS('r')}, {TOKENS('lower(title)')}), lambda w: NOT list_contains({strings(matching.COMMON_ROLE_WORDS)}, w)))::DOUBLE / len(list_intersect({TOKENS('r')}, {TOKENS('lower(title)')})))) * (20::DOUBLE / len(roles)) ELSE 0.0::DOUBLE END"
FOUND = "len(list_filter(cv_terms, lambda t: contains(text, t)))"
CV_PARTS = [
    "CASE WHEN len(cv_skills) > 0 THEN least(CASE WHEN len(tech) > 0 THEN len(list_intersect(cv_skills, tech))::DOUBLE / len(tech) * 15 ELSE 0.0::DOUBLE END + len(list_filter(cv_skills, lambda t: NOT list_contains(tech, t) AND contains(text, t)))::DOUBLE / len(cv_skills) * 10, 25.0::DOUBLE) ELSE 0.0::DOUBLE END",
    f"least(20.0::DOUBLE, coalesce(list_sum(list_transform(roles, lambda r: {ONE_ROLE})), 0.0::DOUBLE))",
    f"CASE WHEN len(cv_terms) = 0 THEN 0.0::DOUBLE WHEN description = '' THEN 5.0::DOUBLE WHEN {FOUND}::DOUBLE / len(cv_terms) > 0.6 THEN least({FOUND}::DOUBLE / len(cv_terms) * 20 * 1.2::DOUBLE, 20.0::DOUBLE) ELSE {FOUND}::DOUBLE / len(cv_terms) * 20 END",
    "CASE WHEN years IS NULL THEN 5.0::DOUBLE " + " ".join(f"WHEN list_contains({strings(ns)}, lower(level)) AND years BETWEEN {lo} AND {hi} THEN 15.0::DOUBLE" for ns, lo, hi in matching.LEVELS) + " WHEN needed THEN CASE WHEN years >= need_low - 1 THEN least(15.0::DOUBLE, 5 + years::DOUBLE / greatest(coalesce(nullif(need_high, 0), years + 2), 1) * 10) ELSE 5.0::DOUBLE END WHEN level <> '' THEN 8.0::DOUBLE ELSE 10.0::DOUBLE END",
    f"CASE WHEN years IS NULL THEN 0 ELSE CASE abs({case([(f'lower(tag) = {lit(k)}', str(v)) for k, v in matching.ORDER.items()], '2')} - CASE WHEN years <= 2 THEN 1 WHEN years <= 5 THEN 2 ELSE 3 END) WHEN 0 THEN 10 WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 2 END END",
    "CASE WHEN verified THEN 5 WHEN regexp_matches(lower(region), 'remote|worldwide|global|anywhere') THEN 5 WHEN region <> '' THEN 2 ELSE 0 END",
    "least(5, CASE WHEN length(description) >= 300 THEN 2 ELSE 0 END + CASE WHEN salary_min > 0 AND salary_max > salary_min THEN 2 ELSE 0 END + CASE WHEN len(tech) >= 3 THEN 1 ELSE 0 END + CASE WHEN len(tech) > 0 THEN 1 ELSE 0 END)",
]
MATCHED = f"{DETAILED}, j AS (SELECT doc_id, title, description, list_transform(skills, lambda s: lower(s)) AS tech, {LEVEL} AS level, {TAG} AS tag, {VERIFIED} AS verified, {REGION} AS region, salary_min, salary_max, need_low, need_high, needed FROM d WHERE is_active), {CV_ROWS}, m AS (SELECT j.*, cv_id, cv.skills AS cv_skills, list_distinct(list_concat(cv.skills, cv.keywords)) AS cv_terms, roles, years, lower(title || ' ' || description || ' ' || array_to_string(tech, ',')) AS text FROM j, cv), w AS (SELECT *, least(100, floor({' + '.join(CV_PARTS)}))::INT AS score FROM m)"
CV_MATCH = P + f", {MATCHED}"
ORACLES["cv_match"] = CV_MATCH + f" SELECT cv_id, doc_id, score, array_to_string(list_sort(list_filter(cv_skills, lambda t: list_contains(tech, t) OR contains(lower(description), t) OR contains(lower(title), t))), ',') AS matched, array_to_string(list_sort(list_filter(list_distinct(list_concat(tech, list_filter({strings(D.COMMON_TECH)}, lambda t: contains(lower(description), t)))), lambda t: NOT list_contains(cv_skills, t))), ',') AS missing FROM w WHERE score > 0"
BAND = "CASE WHEN score >= 80 THEN 'Strong match' WHEN score >= 60 THEN 'Good match' WHEN score >= 40 THEN 'Moderate match' ELSE 'Low match' END"
ORACLES["cv_match_analysis"] = CV_MATCH + f" SELECT cv_id, doc_id, score, {BAND} AS band FROM w WHERE score > 0"
ORACLES["cv_match_counts"] = CV_MATCH + " SELECT cv_id, count(*) AS n, round(avg(score), 4) AS mean_score, count_if(score >= 80)::BIGINT AS strong, count_if(score BETWEEN 50 AND 79)::BIGINT AS good FROM w WHERE score > 0 GROUP BY 1"
ORACLES["matched_jobs"] = CV_MATCH + f" SELECT w.doc_id, p.title, p.company, score, {BAND} AS band FROM w JOIN p USING (doc_id) WHERE score > 0 AND cv_id = 1 AND p.posted_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 14 DAY ORDER BY score DESC, w.doc_id LIMIT 50"
