"""Clusters against brute force on small tables."""

import itertools
import random
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlake.operators import clusters, dedup, semantic
from postlake.operators.dedup import indel_share

ROWS = [
    (1, "greenhouse", "Senior DevOps Engineer", "Acme Inc.", "Remote"),
    (2, "remotive", "Senior DevOps Engineer", "Acme", "Remote"),
    (3, "remoteok", "Sr. DevOps Engineer", "Acme", "Remote"),
    (4, "remotive", "Accountant", "Globex", ""),
    (5, "greenhouse", "Accountants", "Globex", ""),
    (6, "elsewhere", "Accountant", "Hooli", None),
    (7, "remotive", "Senior DevOps Engineer", "Acme", "Remote"),
]
SCHEMA = "doc_id long, source string, title string, company string, location string"


def forms(spark):
    rows = dedup.fuzzy_rows(spark.createDataFrame(ROWS, SCHEMA)).collect()
    return {r.doc_id: r for r in rows}


def test_exact_pairs(spark):
    f, want = forms(spark), {}
    least = {}
    for i, r in sorted(f.items()):
        least.setdefault((r.source, r.l, r.c), i)
    for i in least.values():
        for j in least.values():
            a, b = f[i], f[j]
            if i < j and a.source != b.source and (a.l.find(b.t) >= 0 or b.l.find(a.t) >= 0) and (b.c in a.c or a.c in b.c):
                s, t = indel_share(a.t, b.t), indel_share(a.c, b.c)
                if s >= 0.85 and t >= 0.85:
                    want[i, j] = round((s + t) / 2, 9)
    got = {(r.doc_id, r.other_id): round(r.similarity, 9) for r in clusters.exact_pairs(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == want and len(got) > 1


def test_cascade_stops_at_the_first_level(spark):
    pairs = lambda *p: spark.createDataFrame([(*x, 0.9) for x in p] or [], "doc_id long, other_id long, similarity double")
    got = clusters.cascade(pairs((1, 2)), pairs((1, 3), (3, 4)), pairs((2, 5), (5, 6))).collect()
    assert sorted((r.doc_id, r.other_id, r.kind) for r in got) == [(1, 2, "exact"), (2, 1, "exact"), (3, 1, "fuzzy"), (3, 4, "fuzzy"), (4, 3, "fuzzy"), (5, 2, "semantic"), (5, 6, "semantic"), (6, 5, "semantic")]


def test_clusters_and_views(spark):
    p = spark.createDataFrame(ROWS, SCHEMA)
    built = clusters.built(p)
    own = {r.doc_id: r.cluster_hash for r in clusters.with_cluster(p).collect()}
    got = {r.cluster_hash: (r.primary_id, r["size"]) for r in built.collect()}
    assert got[own[1]][0] == 1 and all(n > 1 for _, n in got.values())
    member = clusters.members(p, built)
    assert {(r.cluster_hash, r.doc_id) for r in member.collect()} == {(h, i) for i, h in own.items() if h in got and got[h][0] != i}
    view = clusters.analysis(built, member, p, p.where("doc_id = 2").select("doc_id", F.lit(7.5).alias("final_score"))).collect()
    assert {r.cluster_hash: r.total_duplicates for r in view} == {h: n for h, (_, n) in got.items()}
    assert {r.best_score for r in view if r.cluster_hash == own[2]} == {7.5}


def test_semantic_search_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, [0.0] * 5), (61, None), (None, x[0].tolist())]
    got = semantic.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 4 == 0, 0.5, block=4).collect()
    e = x.astype(np.float32).astype(float)
    want = {(i, j) for i in range(0, 60, 4) for j in range(60) if i != j and e[i] @ e[j] / np.linalg.norm(e[i]) / np.linalg.norm(e[j]) >= 0.5}
    assert {(r.vec_id, r.other_id) for r in got} == want and len(got) == len(want) > 10


def one_after_another(pairs):
    """The rule as it says: each in the order of ids, unless an earlier seed has matched it."""
    ids = sorted({x for p in pairs for x in p[:2]})
    near = {i: {b if a == i else a for a, b, *_ in pairs if i in (a, b)} for i in ids}
    done, seeds = set(), {}
    for i in ids:
        if i not in done:
            seeds[i] = near[i]
            done |= {i} | near[i]
    return seeds


@pytest.mark.parametrize("seed", range(3))
def test_star_clusters_in_one_pass_and_in_increments(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(*sorted(rng.sample(range(50), 2)), 0.9, "fuzzy") for _ in range(rng.choice([25, 60, 200]))})
    kind = "a long, b long, similarity double, kind string"
    frame = lambda rows: spark.createDataFrame(rows, kind)
    gathered = lambda rows: {(r.seed, r.doc_id) for r in rows}
    states, members = clusters.stars(frame(pairs))
    want = {(s, m) for s, ms in one_after_another(pairs).items() for m in ms}
    assert gathered(members.collect()) == want and {r.id for r in states.collect() if r.kept} == {s for s, _ in want}
    found, known = set(), None
    for lo, hi in ((0, 20), (20, 21), (21, 60)):
        states, members = clusters.stars(frame([p for p in pairs if lo <= p[1] < hi]), known)
        found |= gathered(members.collect())
        known = states if known is None else known.unionByName(states)
    assert found == want
    p = spark.createDataFrame([(i, ["elsewhere", "greenhouse", "remotive"][i % 3]) for i in range(50)], "doc_id long, source string")
    got = {r.seed: (r.primary_id, r["size"]) for r in clusters.starred(clusters.stars(frame(pairs))[1], p).collect()}
    assert got == {s: (max(own, key=lambda i: ([0, 10, 5][i % 3], -i)), len(own)) for s, ms in one_after_another(pairs).items() for own in [ms | {s}]}


def test_edges_keep_the_first_level(spark):
    pairs = lambda *p: spark.createDataFrame([(*x, s) for *x, s in p], "doc_id long, other_id long, similarity double")
    got = clusters.edges(pairs((2, 1, 0.9)), pairs((1, 2, 0.99), (3, 1, 0.8)), pairs((1, 3, 1.0), (4, 5, 0.95))).collect()
    assert {tuple(r) for r in got} == {(1, 2, 0.9, "exact"), (1, 3, 0.8, "fuzzy"), (4, 5, 0.95, "semantic")}


def test_titles_are_rated_only_where_companies_are_alike(spark, monkeypatch):
    """Titles that begin alike are many; a ratio is taken only where the companies' allows a match. Blocks and odd rows change no match."""
    plain = dedup.token_set.func

    @F.pandas_udf("double")
    def strict(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            if any(x.split()[-1] != y.split()[-1] for x, y in zip(a, b, strict=True)):
                raise ValueError("titles of companies that aren't alike")
            yield from plain(iter([(a, b)]))

    monkeypatch.setattr(dedup, "token_set", strict)
    companies = ["Acme Inc.", "Globex", "Hooli", "Umbrella", "Stripe", "Initech"]
    rows = [(i, ["greenhouse", "remotive", "elsewhere"][i // 6 % 3], f"Senior platform engineering {i % 40} k{i % 6}", companies[i % 6]) for i in range(90)]
    rows += [(90, "remotive", None, "Acme"), (91, "greenhouse", "", "Acme"), (92, None, "Senior platform engineering 1 k1", "Globex"), (93, "remotive", "Senior platform engineering k7", None), (94, "greenhouse", "Senior platform engineering k7", ""), (95, "elsewhere", "dev k8", "X"), (96, "remotive", "Sr dev k8", "X")]
    p = spark.createDataFrame(rows, "doc_id long, source string, title string, company string")
    f, least = dedup.fuzzy_rows(p).collect(), {}
    for r in f:
        if r.t:
            least.setdefault((r.source, r.l, r.c), r)
    want = {}
    for a, b in itertools.combinations(sorted(least.values()), 2):
        begins = any(len(y.t) >= 5 and y.t[:20] in x.l for x, y in ((a, b), (b, a)))
        if begins and None not in (a.source, b.source) and a.source != b.source:
            share = 0.7 * next(iter(plain(iter([(pd.Series([a.t]), pd.Series([b.t]))]))))[0] + 0.3 * indel_share(a.c, b.c)
            if share >= 0.85:
                want[a.doc_id, b.doc_id] = share
    assert {(r.doc_id, r.other_id) for r in dedup.fuzzy_pairs(p).collect()} == set(want)
    for block in (1024, 2):
        got = dedup.fuzzy_of(dedup.title_matches(p, dedup.fuzzy_least(0.85), block)).collect()
        assert {(r.doc_id, r.other_id): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want) > 100
