import math

import numpy as np
import pytest

from postlake.llm import topk
from tests.llm.helpers import same_as_sql

SCHEMA = "vec_id long, embedding array<float>, score string, v int"


def brute(rows, k, every):
    good = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for other, (j, w) in enumerate(good) if other != at and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("cell", [20, 10_000])
def test_results_are_those_of_brute_force(spark, cell):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 12) * rng.choice([0.2, 1, 3])).tolist(), "", 0) for i in range(300)]
    rows += [(1000 + i, rows[7][1], "", 0) for i in range(150)]  # one vector many times
    rows += [(2000, None, "", 0), (2010, [], "", 0), (2020, [1.0, None] + [0.0] * 10, "", 0), (2030, [float("nan")] * 12, "", 0), (2040, [float("inf")] * 12, "", 0), (None, rows[0][1], "", 0), rows[10], rows[10], (3000, [1.0, 2.0], "", 0), (3001, [1.0, 2.5], "", 0), (10, rows[11][1], None, None), (4000, [0.0] * 12, "", 0), (2050, [], "", 0), (2051, [], "", 0), (4010, [3e7] + [-1e6] * 11, "", 0)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA).repartition(3), topk.F.col("vec_id") % 10 == 0, cell=cell).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 10)


def test_empty(spark):
    ask = lambda: topk.F.col("vec_id") % 10 == 0
    assert topk.search(spark.createDataFrame([], SCHEMA), ask()).count() == 0
    assert topk.search(spark.createDataFrame([(10, [1.0], "", 0)], SCHEMA), ask()).count() == 0
    assert topk.search(spark.createDataFrame([(11, [1.0], "", 0)], SCHEMA), ask()).count() == 0


def test_annuli_stop_early():
    """With a bound, a block's far vectors are not looked at, and none of the best is lost."""
    import pandas as pd

    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 300, (3000, 4))).astype(np.int64)
    longest = float((x**2).sum(axis=1).max())
    pivots = topk.Pivots({4: longest}, {4: x[:200]}, 4)
    pivot, _, d = pivots.keys(x)
    own = np.flatnonzero(pivot == 0)
    block = pd.DataFrame({"row": own, "id": own, "v": list(x[own]), "d": d[own]})
    q = x[5]
    dq = topk.distances(np.append(q, 0.0)[None, :].astype(float), pivots.pivots[4])[0, 0]
    scores = sorted(((-int(x[i] @ q), int(i)) for i in own if i != 5))[:5]
    got = topk.searched(block, pd.DataFrame({"row": [5], "id": [5], "v": [q], "bound": [None], "dq": [dq]}), {4: longest}, 5)
    assert [(-s, i) for i, s in zip(got["vec_id"], got["score"], strict=True)] == [(s, i) for s, i in scores]


def test_query(spark):
    same_as_sql(spark, topk.op10_pivot_topk, topk.ORACLE, "sf0.01")
