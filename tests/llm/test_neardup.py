import random

import numpy as np
import pytest

from postlake.llm import neardup as d
from postlake.llm.shingles import shingle_set
from tests.llm.helpers import same_as_sql

SCHEMA = "doc_id long, text string, k string, n int"


def brute(rows, n, least):
    sets = [shingle_set(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                shared = len(a & sets[j])
                if least[1] * shared >= least[0] * (len(a) + len(sets[j]) - shared):
                    root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(r[0]), len(sets[i]), str(r[0] if not sets[i] else min(ids, default=None))))
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdef") + str(rng.randrange(500)) for _ in range(n)]
    rows, passage = [], text(30)
    while len(rows) < size:
        base = text(rng.choice([2, 4, 20, 60, 300])) + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 25])):
                copy[rng.randrange(len(copy))] = "z" + str(rng.randrange(99))
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(copy).title(), "x", 0))
    return rows + [(900, None, None, None), (901, "", "", 0), (902, " \n ", "", 0), (903, "one", "", 0), (904, "ONE", "", 0), rows[3], rows[3], (None, rows[5][1], "", 0), (None, "only here without an id", "", 0), (None, "only here without an id", "", 0), (905, " ".join(text(40_000)), "", 0)]


@pytest.mark.parametrize(("n", "least"), [(3, (85, 100)), (5, (4, 5))])
def test_components_are_those_of_brute_force(spark, n, least):
    rows = corpus(n, 160)
    got = d.component_ids(spark.createDataFrame(rows, SCHEMA).repartition(3), n=n, least=least).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, n, least)


@pytest.mark.parametrize("extra", ["k", "kept_key", "h"])
def test_one_of_each_component_stays(spark, extra):
    rows = corpus(8, 60) + [(None, None, "x", 1), (None, "", "y", 2), (901, "", "z", 3), (5, "5 differs", "", 0), (5, "", "", 0)]
    kept = d.deduplicated(spark.createDataFrame(rows, SCHEMA.replace(" k ", f" {extra} "))).collect()
    free = lambda r: r[0] is None or not shingle_set(r[1], 5)
    named = [r.doc_id for r in kept if not free(r)]
    assert sorted(map(tuple, filter(free, kept)), key=repr) == sorted(filter(free, rows), key=repr)
    assert len(named) == len(set(named)) and set(map(str, named)) == {w[0] for w in brute(rows, 5, (4, 5)) if w[0] == w[2] and w[1] > 0 and w[0] != "None"}
    assert kept[0].asDict().keys() == {"doc_id", "text", extra, "n"}


def test_band_sizes_leave_few_pairs_at_the_threshold_apart():
    for least in ((85, 100), (4, 5), (1, 2), (99, 100)):
        rng, rows = np.random.default_rng(5), d.band_rows(least)
        size = 4000
        shared = round(2 * size * least[0] / (sum(least)))
        apart = 0
        for _ in range(40):
            x = rng.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
            a, b = (d.sketches(s, np.array([0]))[0] for s in (x[:size], x[size - shared :]))
            same = (a == b)[: used(rows)].reshape(-1, rows).all(axis=1)
            apart += not same.any()
        assert apart == 0


def used(rows):
    return d.REGISTERS // rows * rows


def test_empty(spark):
    assert d.component_ids(spark.createDataFrame([], SCHEMA)).count() == 0
    assert d.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    whole, a, b = (d.sketches(s, np.array([0]))[0] for s in (x, x[:2000], x[1000:]))
    assert np.array_equal(whole, np.maximum(a, b))
    near, far = x[:950], np.concatenate([x[:500], x[2000:2500]])
    regs = d.sketches(np.concatenate([x[:1000], near, far]), np.array([0, 1000, 1950]))
    size = np.array([1000.0])
    assert d.plausible(regs[:1], regs[1:2], size, np.array([950.0]), 0.85)[0]
    assert not d.plausible(regs[:1], regs[2:], size, size, 0.85)[0]
    share = (regs[0] == regs[1]).mean()
    assert abs(share - 0.95) < 0.06


def test_query(spark):
    same_as_sql(spark, d.op3_near_duplicates, d.ORACLE, "sf0.01")


def test_texts_move_a_part_at_a_time(spark, monkeypatch):
    sizes = []

    def watched(df, name, real=d.written):
        out = real(df, name)
        sizes.extend([out.count()] if name == "texts" else [])
        return out

    monkeypatch.setattr(d, "written", watched)
    rows = [(i, " ".join(f"w{(i // 2) * 100 + k}" for k in range(60)) + " x" * (i % 2)) for i in range(200)]
    got = d.component_ids(spark.createDataFrame(rows, "doc_id long, text string"), n=3, least=(85, 100)).collect()
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in got) and len(got) == 200
    assert len(sizes) == d.TEXT_PARTS and sum(sizes) == 200 and max(sizes) < 100
