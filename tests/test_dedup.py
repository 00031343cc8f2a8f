"""Pairs of postings against brute force."""

import itertools
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from postlake.functions import text as T
from postlake.operators import dedup

KIND = "doc_id long, source string, title string, company string, description string"
TITLES = ["Senior DevOps Engineer", "DevOps Engineer", "DevOps Engineer", "Sr. Platform Engineer", "Senior Platform Engineers wanted", "Full Stack Developer", "Fullstack Developer (m/w)", "Dev", "Data Analyst and Business Intelligence Lead", "Data Analyst and Business Intelligence", "", None, "Remote role"]
COMPANIES = ["Acme Inc.", "Acme", "Acmes GmbH", "Globex", "", None]


def rows_of(n=150):
    return [(i * 7 % n, [None, "a", "b", "c"][i % 11 % 4], TITLES[i % len(TITLES)], COMPANIES[i // 13 % len(COMPANIES)], ["we build things in python", "we build thing in python", "", None][i % 4]) for i in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def plain(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a, b):
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both, left, right = (" ".join(sorted(x)) for x in (s & t, s - t, t - s))
    if both and not (left and right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([plain(one, two), *([plain(both, one), plain(both, two)] if both else [])])


def test_fuzzy_pairs_and_members_are_those_of_brute_force(spark):
    df = spark.createDataFrame(rows_of(), KIND)
    rows = df.select("doc_id", "source", F.lower("title").alias("l"), T.standard_title(F.col("title")).alias("t"), T.standard_company(F.col("company")).alias("c")).collect()
    want = {}
    for a, b in itertools.permutations(rows, 2):
        if a.source and b.source and a.source != b.source and len(a.t) >= 5 and a.t[:20] in (b.l or ""):
            s = 0.7 * token_set(a.t, b.t) + 0.3 * plain(a.c, b.c)
            if s >= 0.85:
                want[min(a.doc_id, b.doc_id), max(a.doc_id, b.doc_id)] = s
    got = dedup.fuzzy_with_members(df).collect()
    of = {r.doc_id: r.representative for r in got if r.other_id is None}
    assert sorted(r.doc_id for r in got if r.other_id is None) == sorted(r.doc_id for r in rows)
    least = {}
    for r in rows:
        least[r.source, r.l, r.c] = min(r.doc_id, least.get((r.source, r.l, r.c), r.doc_id))
    assert of == {r.doc_id: least[r.source, r.l, r.c] for r in rows}
    classes = {}
    for d, r in of.items():
        classes.setdefault(r, []).append(d)
    pairs = [r for r in got if r.other_id is not None]
    found = {(min(x, y), max(x, y)): r.similarity for r in pairs for x in classes[r.doc_id] for y in classes[r.other_id]}
    assert found == pytest.approx(want) and len({(r.doc_id, r.other_id) for r in pairs}) == len(pairs)
    names = {r.doc_id: (r.l, r.c) for r in rows}
    assert any({names[a][0], names[b][0]} == {"senior devops engineer", "devops engineer"} for a, b in found)
    assert not any({names[a][1], names[b][1]} == {"acme", "globex"} for a, b in found)


def test_copies_are_near_duplicates_too(spark):
    df = spark.createDataFrame(rows_of(60), KIND)
    one = dedup.near_rows(df).collect()
    share = lambda x, y: SequenceMatcher(None, x, y).ratio()

    def similarity(a, b):
        common = bool(set(a.d.split()) & set(b.d.split()))
        described = 1.0 if not a.d and not b.d else share(a.d, b.d) if common else 0.0
        return 0.5 * share(a.t, b.t) + 0.3 * share(a.c, b.c) + 0.2 * described

    want = set()
    for a, b in itertools.combinations(sorted(one), 2):
        same = (a.t, a.c, a.d) == (b.t, b.c, b.d)
        if same or (a.t and a.t[:3] == b.t[:3] and set(a.t.split()) & set(b.t.split())):
            reps = [min(x.doc_id for x in one if x[1:] == y[1:]) for y in (a, b)]
            first, second = (next(x for x in one if x.doc_id == i) for i in sorted(reps))
            if same or similarity(first, second) >= 0.75:
                want.add((a.doc_id, b.doc_id))
    got = dedup.near_with_members(df, 0.75).collect()
    classes = {}
    for r in got:
        if r.other_id is None:
            classes.setdefault(r.representative, []).append(r.doc_id)
    found = {p for c in classes.values() for p in itertools.combinations(sorted(c), 2)}
    found |= {(min(x, y), max(x, y)) for r in got if r.other_id is not None for x in classes[r.doc_id] for y in classes[r.other_id]}
    assert found == want and sorted(d for c in classes.values() for d in c) == sorted(r.doc_id for r in one)
    assert any(len(c) > 1 for c in classes.values()) and any(r.other_id is not None for r in got)
