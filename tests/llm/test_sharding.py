import zlib
from collections import Counter

from postlake.llm import sharding
from tests.llm.helpers import same_as_sql

SCHEMA = "doc_id long, text string, shard string, cell int"


def place(spark, rows, **how):
    return sharding.assign(spark.createDataFrame(rows, SCHEMA), **how).collect()


def test_every_row_has_a_slot_and_counts_are_at_most_one_apart(spark):
    rows = [(i, f"text {i % 7} é", "x", 1) for i in range(203)] + [(None, None, None, None)] * 3 + [(5, "text 5 é", "y", 2)] * 9001 + [(6, "", "", 0), (6, None, "", 0)]
    got = place(spark, rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    for shard in per:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(per[shard]))


def test_one_more_shard_moves_few_rows(spark):
    rows = [(i, "t", "", 0) for i in range(4000)]
    before = {r.doc_id: r.shard for r in place(spark, rows)}
    after = {r.doc_id: r.shard for r in place(spark, rows, shards=9)}
    moved = sum(before[i] != after[i] for i in before)
    assert moved < 0.4 * len(rows)  # dealing by remainder would move 8 of 9


def test_turns_place_all(spark):
    points = sharding.ring(3, 4)
    parts = sharding.allocate([50] + [0] * (len(points) - 1), [sharding.clockwise(points, i) for i in range(len(points))], [17, 17, 16])
    assert sum(p[2] - p[1] for p in parts) == 50


def test_empty(spark):
    assert place(spark, []) == []
    assert len(place(spark, [(1, "a", "", 0)])) == 1


def test_query(spark):
    same_as_sql(spark, sharding.op7_ring_sharding, sharding.oracle_sql(), "sf0.001")
