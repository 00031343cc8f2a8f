import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm import decontamination as d
from postlake.llm.shingles import shingle_set, shingles, words
from tests.llm.helpers import same_as_sql

SCHEMA = "doc_id long, text string, item string, shared int"
ITEMS = "item_id long, text string, doc_id long"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abAB \n\t\x0bé\x85")), max_size=30)), max_size=8), st.integers(1, 5))
def test_hashes_stand_for_the_shingles(texts, n):
    column = pa.array(["x y", *texts], pa.string()).slice(1)
    hashes, at = shingles(column, n)
    for i, text in enumerate(texts):
        assert len(set(hashes[at[i] : at[i + 1]].tolist())) == len(shingle_set(text, n))
    same = {}
    for i, text in enumerate(texts):
        assert same.setdefault(frozenset(shingle_set(text, n)), set(hashes[at[i] : at[i + 1]].tolist())) == set(hashes[at[i] : at[i + 1]].tolist())
    assert len(words(column)[1]) == len(texts) + 1


def test_pairs_are_those_of_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n))
    items = [(i, text(rng.choice([6, 9, 17, 30, 61, 130])), i) for i in range(40)] + [(40, "three short words", 0), (41, "", 0), (42, None, None), (None, "an item without a name that is ten words long", 0), (3, "the same words again and again and then once more", 1)]
    docs = []
    for i in range(60):
        body = text(rng.choice([0, 50, 400, 3000])).split(" ")
        for _ in range(rng.randrange(3)):
            passage = (rng.choice(items)[1] or "").upper().split(" ")
            for _ in range(rng.choice([0, 0, 1, 3])):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((i, "\n".join(body), "c", 2))
    docs += [(99, None, None, None), (98, "", "", 0), (97, "Three short  words", "", 0), docs[0], docs[0], (None, items[5][1], "", 0), (96, text(30000) + " " + items[0][1], "", 0)]
    want = []
    for doc_id, body, *_ in docs:
        own = shingle_set(body, 5)
        want += [(str(doc_id), str(item), len(s), len(s & own)) for item, t, _ in items if (s := shingle_set(t, 5)) and 5 * len(s & own) >= 4 * len(s)]
    frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    got = [(str(r.doc_id), str(r.item_id), r.n_item, r.n_shared) for r in d.contained(*frames).collect()]
    assert sorted(got) == sorted(want) and len(want) > 30
    assert sorted(str(r.doc_id) for r in d.clean(*frames).collect()) == sorted(str(x[0]) for x in docs if str(x[0]) not in {w[0] for w in want})


def test_blocks_of_items_give_the_same(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "", 0), (2, "q r s t u v", "", 0), (3, "z", "", 0)], SCHEMA)
    items = spark.createDataFrame([(1, "a b c d e f", 0), (2, "q r s t u v", 0), (3, "b c d e f g", 0)], ITEMS)
    want = sorted(d.contained(docs, items).collect())
    assert sorted(d.contained(docs, items, block=12).collect()) == want and len(want) == 3
    assert [r.doc_id for r in d.clean(docs, items, block=12).collect()] == [3]


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA), spark.createDataFrame([], ITEMS)
    assert d.contained(docs, items).count() == 0 and d.clean(docs, items).count() == 1
    assert d.contained(docs.limit(0), spark.createDataFrame([(1, "a", 0)], ITEMS)).count() == 0


def test_query(spark):
    same_as_sql(spark, d.op5_decontamination, d.ORACLE, "sf0.01")
