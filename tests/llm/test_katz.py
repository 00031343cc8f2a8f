import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from postlake.llm import katz
from postlake.llm.common import remainder, words_of

SCHEMA = "doc_id long, text string, score double, kind string"


def brute(rows):
    """Katz's model with dictionaries."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    lists = [[*words_of(r[1]), "</s>"] for r in rows]
    train = [x for x, r in zip(lists, rows, strict=True) if fold(r[0]) != 2]
    c1 = Counter(w for x in train for w in x)
    c2 = Counter(p for x in train for p in zip(["<s>", *x], x, strict=False))
    ch = Counter(p[0] for x in train for p in zip(["<s>", *x], x, strict=False))
    total, kinds, k = sum(c1.values()), len(c1), katz.DISCOUNTED

    def parts(counts):
        n = np.bincount([min(c, k + 2) for c in counts], minlength=k + 3).astype(float)
        return katz.discounts(n)

    d1, d2 = parts(c1.values()), parts(c2.values())
    kept1 = {w: c * (d1[c] if c <= k else 1) for w, c in c1.items()}
    left = total - sum(kept1.values())
    below1, unknown = (total, left / total) if left >= 0.5 else (total + 1, (left + 1) / (total + 1))
    p1 = lambda w: kept1[w] / below1 if w in kept1 else unknown
    kept2 = {p: c * (d2[c] if c <= k else 1) for p, c in c2.items()}
    sums, lower, below, back = Counter(), Counter(), {}, {}
    for (h, w), c in kept2.items():
        sums[h] += c
        lower[h] += p1(w)
    for h, c in ch.items():
        below[h] = c + (c - sums[h] < 0.5)
        back[h] = (1 - sums[h] / below[h]) / (1 - lower[h])
    p2 = lambda h, w: kept2[h, w] / below[h] if (h, w) in kept2 else back.get(h, 1) * p1(w)
    out = []
    for r, x in zip(rows, lists, strict=True):
        base = sum(math.log10((c1[w] + 1) / (total + kinds + 1)) for w in x)
        out.append((str(r[0]), fold(r[0]) == 2, len(x), sum(c1[w] > 0 for w in x), total, base, sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *x], x, strict=False))))
    return sorted(out), p1, p2, c1, ch


def corpus(size, seed=4):
    rng = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(300)]
    rows = []
    for i in range(size):
        n, at, body = rng.choice([0, 1, 5, 40, 200]), 0, []
        for _ in range(n):
            at = (at * 7 + int(rng.expovariate(0.2))) % 300 if rng.random() < 0.8 else rng.randrange(300)
            body.append(vocabulary[at])
        rows.append((i, " ".join(body).title() + (" new%d" % i) * (i % 3), 0.0, "x"))
    return rows + [(None, None, None, None), (None, "w1 w2", 0.0, ""), (700, "", 0.0, ""), rows[3], rows[3], (701, "w1 w2 " * 3000, 0.0, "")]


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_scores_are_those_of_brute_force(spark, block):
    rows = corpus(120)
    got = katz.score(spark.createDataFrame(rows, SCHEMA).repartition(3), remainder(katz.F.col("doc_id"), 7) == 2, block=block).collect()
    want, p1, p2, c1, ch = brute(rows)
    got = sorted((str(g[0]), *g[1:]) for g in got)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    assert sum(map(p1, c1)) + p1("never seen") == pytest.approx(1)
    for h in list(ch)[:40]:
        assert sum(p2(h, w) for w in c1) + p2(h, "never seen") == pytest.approx(1)


def test_small_and_empty(spark):
    held = lambda: remainder(katz.F.col("doc_id"), 7) == 2
    assert katz.score(spark.createDataFrame([], SCHEMA), held()).count() == 0
    rows = [(1, "a a a", 0.0, "")]
    [g] = katz.score(spark.createDataFrame(rows, SCHEMA), held()).collect()
    assert g.score == pytest.approx(brute(rows)[0][0][6])
    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    [g] = katz.score(spark.createDataFrame([(only_held, "a b", 0.0, "")], SCHEMA), held()).collect()
    assert (g.train_tokens, g.n_known, g.score, g.base_score) == (0, 0, 0.0, 0.0)


def test_query_beats_the_base(spark):
    got = katz.op8_katz_scores(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = brute(rows)[0]
    for g, w in zip(sorted((str(g[0]), *g[1:]) for g in got), want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    assert sum(g.score for g in got if g.held_out) > sum(g.base_score for g in got if g.held_out)


def test_pairs_seen_once_count(spark, monkeypatch):
    rows = corpus(120, seed=9)
    got = katz.score(spark.createDataFrame(rows, SCHEMA).repartition(3), remainder(katz.F.col("doc_id"), 7) == 2, block=64).collect()
    want = brute(rows)[0]
    for g, w in zip(sorted((str(g[0]), *g[1:]) for g in got), want, strict=True):
        assert g[:5] == w[:5] and g[6] == pytest.approx(w[6], rel=1e-9)
