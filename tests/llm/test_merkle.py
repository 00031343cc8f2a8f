import random
import zlib
from hashlib import sha256

import pytest

from postlake.llm import merkle
from tests.llm.helpers import same_as_sql

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, rank int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes):
    """The root, and each leaf's path as (place, siblings) from the bottom up."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            path.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, paths = {}, {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r[:5])))
        subs[s], paths[s] = plain_tree([plain_leaf(r[:5]) for r in by[s]])
    root, above = plain_tree([subs[s] for s in sources])
    out = []
    for s, top in zip(sources, above, strict=True):
        for row, path in zip(by[s], paths[s], strict=True):
            whole = path + top
            tampered = zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 5 == 0
            changed = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            node = plain_leaf((*row[:4], changed)) if tampered else plain_leaf(row[:5])
            for place, others in whole:
                node = h(*others[:place], node, *others[place:])
            out.append((row[0], plain_leaf(row[:5]), subs[s], root, h(*(x for _, o in whole for x in o)), node, node == root))
    return out


def digests(spark, rows, height=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    got = merkle.manifest(df, merkle.F.translate("text", merkle.UPPER, merkle.LOWER), merkle.remainder(merkle.F.col("doc_id"), 5) == 0, merkle.emit_digests, schema, height)
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes:
        for _ in range(n):
            rows.append((rng.randrange(-50, 10**6), source, rng.choice(["en", None, ""]), rng.choice([None, 5]), rng.choice(["lower", "Upper É", "", None, "x" * 3000, f"T{rng.random()}"])))
    rng.shuffle(rows)
    return rows + [(None, "a", None, None, None), (None, None, "en", 3, "No id"), rows[0], rows[0]] + ([(7, "a", "en", 1, "V" * 2_000_000)] if seed == 1 else [])


@pytest.mark.parametrize(("seed", "sizes"), [(1, [("a", 300), ("b", 16), ("c", 17), ("", 1), (None, 33), ("é", 256), ("Z", 257)]), (2, [(f"host {i}", 1 + i % 3) for i in range(40)]), (3, [("only", 45)])])
def test_manifest_is_that_of_whole_lists(spark, seed, sizes):
    rows = corpus(seed, sizes)
    assert digests(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("height", [1, 2])
def test_small_blocks_climb_several_times(spark, height):
    """With blocks of 16 or 256 leaves the upper trees have blocks of their own."""
    rows = corpus(height + 10, [("hot", 700), ("b", 1), ("c", 257)] + [(f"s{i}", 1) for i in range(30)])
    assert digests(spark, rows, height) == sorted(brute(rows), key=repr)


def test_a_block_of_full_height(spark):
    rows = [(i, "hot", "en", 1, f"Text {i}") for i in range(4096 + 18)] + [(9, "other", None, None, None)]
    assert digests(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 255, 256, 257, 300])
@pytest.mark.parametrize("extra", [0, 1])
def test_traversal_yields_each_path_and_holds_few_nodes(count, extra):
    nodes = [h(str(i)) for i in range(count)]
    levels = merkle.levels_of(count) + extra
    _, want = plain_tree(nodes)
    for i, path in enumerate(merkle.traversal(nodes.__getitem__, count, levels)):
        got = [(place, run[:place] + run[place + 1 :]) for place, run in path]
        assert got[: len(want[i])] == want[i] and all(not others for _, others in got[len(want[i]) :])
        assert all(len(run) <= merkle.RUN for _, run in path)


def test_builders_keep_a_started_run_a_level():
    ahead, most = merkle.Ahead(3), 0
    for i in range(70_000):
        ahead.take(h(str(i)))
        most = max(most, sum(map(len, ahead.stack)))
    assert most <= 4 * merkle.RUN


def test_proofs_lead_to_the_root(spark):
    rows = corpus(5, [("a", 40), ("b", 3), (None, 2)])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = merkle.manifest(df).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1
    for r in got:
        assert merkle.folded(r.leaf, [(p.place, merkle.digests(bytes(p.siblings))) for p in r.proof]) == r.root


def test_empty_and_single(spark):
    assert digests(spark, []) == []
    assert digests(spark, [(1, None, None, None, None)]) == brute([(1, None, None, None, None)])


def test_query(spark):
    same_as_sql(spark, merkle.op13_merkle_manifest, merkle.oracle_sql())
