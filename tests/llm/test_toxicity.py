import zlib

import numpy as np
import pytest

from postlake.llm import toxicity as t

SCHEMA = "doc_id long, text string, score double, label int"
LABELS = "doc_id long, toxic int, text string"


def direct(model, text):
    """The score of a text from each n-gram's row, one at a time."""
    def value(word):
        marked = f"<{word}>"
        rows = [t.subwords([word])[0]]
        assert len(rows[0]) == 1 + sum(max(0, len(marked) - n + 1) for n in t.GRAMS)
        return float(np.mean(model.weights[rows[0]]))

    words = t.tokens(text)
    values = [value(w) for w in words]
    means = [np.mean(values[i : i + t.WIDTH]) for i in range(max(1, len(values) - t.WIDTH + 1))] if values else [0.0]
    return 1 / (1 + np.exp(-(model.bias + max(means))))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgilmnorst"), rng.integers(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        body = list(rng.choice(words, rng.integers(5, 200)))
        if i % 4 == 0:
            body.insert(int(rng.integers(len(body))), ["wretch", "wretched", "vermin", "verminous"][i // 4 % 4])
        rows.append((i, " ".join(body), 0.0, 1))
        labels.append((i, int(i % 4 == 0), "x"))
    return rows, labels


def test_held_out_and_misspelt(spark, table):
    rows, labels = table
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (1, None, None), (None, 1, None), (7, 0, "")], LABELS)
    model = t.train(docs, marks)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == (r[0] % 4 == 0) for r, s in zip(held, model.scores([r[1] for r in held]), strict=True)]) > 0.95
    plain, misspelt = model.scores(["somber lantern", "the wretchhed man"])
    assert misspelt > plain


def test_scores_are_those_of_one_gram_at_a_time(spark, table):
    model = t.fit([r[1] for r in table[0]], [x[1] for x in table[1]])
    odd = [None, "", "  !?", "vermin", "é" * 50, "a b", "word " * 20_000 + "vermin"]
    rows = [(i, x, 0.0, 0) for i, x in enumerate(odd)] + [(3, "vermin", None, None), (None, "vermin", 0.0, 0)]
    got = spark.createDataFrame(rows, SCHEMA).select("doc_id", t.score(spark, model, t.F.col("text")).alias("s")).collect()
    assert sorted(g.s for g in got) == pytest.approx(sorted(direct(model, r[1]) for r in rows), abs=1e-5)


def test_the_sample_is_bounded(spark, table, monkeypatch):
    """Whole texts in the order of hashed ids, as far as the bound on characters goes; a text that doesn't fit is left out, however long."""
    rows, labels = table
    docs = spark.createDataFrame([*rows, (1001, "long " * 50_000, 0.0, 0)], SCHEMA)
    seen = []
    monkeypatch.setattr(t, "fit", lambda texts, marks: seen.append((texts, marks)))
    t.train(docs, spark.createDataFrame([*labels, (1001, 1, "")], LABELS), characters=20_000)
    t.train(docs, spark.createDataFrame([*labels, (1001, 1, "")], LABELS))
    few, whole = seen
    assert 15_000 < sum(map(len, few[0])) <= 20_000 and set(few[0]) < set(whole[0])
    assert sorted(whole[0]) == sorted(x[1] for x in [*rows, (1001, "long " * 50_000)] if zlib.crc32(str(x[0]).encode()) % 5)


def test_without_labels_or_rows(spark, table):
    docs = spark.createDataFrame(table[0], SCHEMA)
    assert t.train(docs, spark.createDataFrame([], LABELS)).scores(["a b"])[0] == pytest.approx(0.25)
    assert t.train(docs.limit(0), spark.createDataFrame(table[1], LABELS)).scores([""])[0] == pytest.approx(0.25)
    assert t.train(docs, spark.createDataFrame([(1, 0, ""), (2, 0, "")], LABELS)).scores(["a"])[0] < 0.5


def test_query(spark):
    got = {r.doc_id: r for r in t.op2_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if r.held_out and i in labels]
    assert {i for i, r in got.items() if r.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    toxic, clean = ([r.score for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean(np.array(toxic) >= 0.5) > 0.75 and np.mean(np.array(clean) < 0.5) > 0.98
    assert np.mean([[x > y for y in clean] for x in toxic]) > 0.95  # the area under the curve
