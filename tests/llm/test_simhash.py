import random
import re

import numpy as np
import pytest
import xxhash

from postlake.llm import simhash as sh
from tests.llm.helpers import DATA

SCHEMA = "doc_id long, text string, fp string, component_id int"


def plain_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(prints, ids, distance=3):
    """Component ids by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    low = {}
    for i, own in enumerate(ids):
        if own is not None:
            low[find(i)] = min(own, low.get(find(i), own))
    return [low.get(find(i)) for i in range(len(ids))]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    while len(rows) < 150:
        base = [rng.choice(["ab", "É", "x", "zz"]) + str(rng.randrange(300)) for _ in range(rng.choice([1, 2, 3, 5, 60, 400]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(99))
            rows.append((len(rows), rng.choice([" ", "\n ", "\x0b"]).join(copy).title(), "x", 0))
    rows += [(900, None, None, None), (901, "", "", 0), (902, " \n ", "", 0), (903, "one", "", 0), (904, "ONE\t", "", 0), rows[3], rows[3], (None, rows[5][1], "", 0), (None, "only here without an id", "", 0), (905, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000)), "", 0), (906, "nb space   em", "", 0)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    prints = [plain_print(r[1]) for r in rows]
    got = sh.component_ids(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = zip((r[0] for r in rows), prints, brute(prints, [r[0] for r in rows]), strict=True)
    assert sorted(map(repr, ((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got))) == sorted(map(repr, want))


def ball(seed, size):
    """Fingerprints of a few dense balls, each of which would fill one bucket of most choices of runs."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    centres.append(centres[0] ^ 0b1111)
    out = set()
    while len(out) < size:
        x = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("most", [2, 7, 4096])
def test_links_join_what_all_pairs_join_however_small_buckets_are(spark, most):
    prints = ball(most, 300)
    classes = spark.createDataFrame([(sh.signed(x),) for x in prints], "fp long")
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in sh.links(sh.buckets(classes, most)).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    # the smallest fingerprint of each component stands in for an id
    assert [find(x) for x in prints] == brute(prints, prints)


def test_every_close_pair_shares_a_mask():
    rng = random.Random(3)
    for free in ((1 << 64) - 1, 0xF0F0FFFF00001234, 0b10110):
        places = [i for i in range(64) if free >> i & 1]
        for _ in range(300):
            change = sum(1 << i for i in rng.sample(places, min(3, len(places))))
            assert any(change & m == 0 for m in sh.masks(free))


def test_forest_is_linear(spark):
    fp = np.array([1 << i for i in range(40)] + [0], np.uint64)
    a, b = sh.forest(np.concatenate([fp, fp]), np.repeat([0, 1], 41), 3)
    assert len(a) == len(b) == 80


def test_empty(spark):
    assert sh.component_ids(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in sh.component_ids(spark.createDataFrame([(7, None, "", 1)], SCHEMA)).collect()] == [(7, 0, 7)]


def test_query(spark):
    """Whole documents against all pairs."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op12_simhash(spark, f"{DATA}/sf0.001").collect()}
    prints = [plain_print(r.text) for r in docs]
    low = brute(prints, [r.doc_id for r in docs])
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(docs, prints, low, strict=True)}
    assert any(k != v[1] for k, v in got.items())
