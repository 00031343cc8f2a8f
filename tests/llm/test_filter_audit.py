import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from postlake.llm import filter_audit as fa
from tests.llm.helpers import same_as_sql

DOCS, LABELS = "doc_id long, text string, source string, part int, bits string", "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """Every order is run over every row."""
    rows = []
    for i, text, source, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {x for x in labels if i is not None and x[0] == i}
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(d[0] is not None and d[0] < i and (d[1] or "") == t for d in docs)}
        rows.append((source or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, totals = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                failing = [r for r in rows if r[0] == part and r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    got = fa.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(found) == len(got)
    return found


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    for i in range(150):
        n = rng.choice([0, 1, 30, 199, 200, 201, 260])
        words = [rng.choice("abcdefghij") + str(rng.randrange(rng.choice([3, 40, 900]))) for _ in range(n)]
        text = rng.choice([" ", "\n", "\x0b  "]).join(words)
        text = rng.choice([text, text, text.title(), text + " #", "É" * 50 + text])
        docs.append((i, rng.choice([text, docs[-1][1] if docs else ""]), rng.choice(["web", "web", "web", "wiki", "", None, "ü"]), 1, "x"))
    docs += [(None, docs[3][1], "web", 0, ""), (None, None, None, None, None), (5, docs[5][1], "web", 0, ""), (5, docs[5][1], "wiki", 0, ""), (5, "other words", "web", 0, ""), (900, " ".join(f"w{i}" for i in range(60_000)), "long", 0, "")]
    docs += [(1000 + i, "the same text", "web", 0, "") for i in range(90)]  # a hot group of copies
    labels = [(rng.choice([None, *range(160)]), rng.choice([0, 1, None, 2]), rng.choice([0, 1, None]), "x") for _ in range(130)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_is_that_of_running_every_order(spark, seed):
    docs, labels = corpus(seed)
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, None, None, 1, "")], []) == brute([(1, None, None)], [])


def test_many_parts_share_batches(spark, monkeypatch):
    monkeypatch.setattr(fa, "PARTS", 7)
    docs = [(i, f"text {i % 50}", f"host {i % 60}", 0, "") for i in range(400)]
    assert audited(spark, docs, [(3, 1, 1, "")]) == brute(docs, [(3, 1, 1)])


def test_bitsets_of_ragged_parts():
    rng = np.random.default_rng(4)
    part, bits = [str(x) for x in rng.integers(0, 9, 500)], rng.integers(0, 1 << 5, 500).astype(np.int32)
    names, out = fa.survivors(pa.array(part), bits, 3, 2)
    for i, name in enumerate(names.to_pylist()):
        own = bits[np.array(part) == name]
        for s in range(8):
            alive = own[(own & s) == 0]
            assert out[i, s].tolist() == [len(alive), (alive >> 3 & 1).sum(), (alive >> 4 & 1).sum()]


def test_query(spark):
    same_as_sql(spark, fa.op11_filter_audit, fa.ORACLE)
