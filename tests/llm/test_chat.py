import itertools
import random

from postlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, cost int, t string"


def legal(roles):
    return bool(roles) and all(b in chat.NEXT[a] for a, b in zip(["", *roles], roles, strict=False)) and roles[-1] == chat.LAST


def brute(roles):
    """The least cost over all ways to label, merge and insert (up to two empty turns before each turn and at the end)."""
    best = None
    fill = [p for n in range(3) for p in itertools.product(chat.ROLES, repeat=n)]
    for labels in itertools.product(chat.ROLES, repeat=len(roles)):
        relabel = [chat.relabelling(chat.named(o), r) for o, r in zip(roles, labels, strict=True)]
        cost0 = sum(c for c, _ in relabel)

        def extend(i, out, cost, counts):
            nonlocal best
            if best is not None and (cost, *counts) >= best:
                return
            if i == len(roles):
                for tail in fill:
                    if legal([*out, *tail]):
                        total = (cost + chat.INSERT * len(tail), counts[0], counts[1] + len(tail), counts[2])
                        best = total if best is None else min(best, total)
                return
            if out and out[-1] == labels[i]:
                extend(i + 1, out, cost + chat.MERGE, (counts[0], counts[1], counts[2] + 1))
            for f in fill:
                now = [*out, *f, labels[i]]
                if all(b in chat.NEXT[a] for a, b in zip(["", *now], now, strict=False)):
                    extend(i + 1, now, cost + chat.INSERT * len(f), (counts[0], counts[1] + len(f), counts[2]))

        extend(0, [], cost0, (sum(n for _, n in relabel), 0, 0))
    return best


def test_costs_are_the_least():
    rng = random.Random(1)
    for _ in range(120):
        roles = [rng.choice(["system", "user", "assistant", "Human ", "tool", None]) for _ in range(rng.choice([1, 2, 3, 4]))]
        cost, steps = chat.repair(roles)
        assert cost == brute(roles)
        assert legal([r for r, _, merged in steps if not merged])
        assert [i for _, i, _ in steps if i >= 0] == list(range(len(roles)))


def test_rendering_and_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", 0, ""), (1, 0, "user", "a", 0, ""), (1, 1, "assistant", "b", 9, "x"), (2, 0, "user", "x", 0, ""), (2, 1, "user", None, 0, ""), (2, None, "bot", "<|end|>", 0, ""), (None, 0, "user", "q", 0, ""), (None, 0, None, None, None, None), (3, 0, "assistant", "", 0, ""), (4, 0, "system", "long " * 50_000, 0, "")]
    got = {(r.conv_id, r.n_turns, r.roles): r for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 2, "user,assistant"].rendered == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n" and got[1, 2, "user,assistant"].cost == 0
    assert got[2, 3, "user,assistant"].rendered == "<|user|>\nx<|end|>\n<|assistant|>\n< |end|><|end|>\n"
    assert (None, 1, "user,assistant") in got and got[3, 1, "user,assistant"].n_inserted == 1
    assert got[4, 1, "system,user,assistant"].n_inserted == 2
    assert sum(k[0] is None for k in got) >= 1
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
    assert chat.formatted(spark.createDataFrame(rows[6:8], SCHEMA)).count() == 2


def test_query(spark):
    got = chat.op9_chat_format(spark, "/root/testdata/sf0.001").collect()
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    assert {r.conv_id for r in got} == {t.conv_id for t in turns}
    for r in got:
        own = sorted({(t.turn, t.role, t.text) for t in turns if t.conv_id == r.conv_id})
        assert r.n_turns == len(own) and legal(r.roles.split(","))
        if len(own) <= 4:
            assert (r.cost, r.n_relabelled, r.n_inserted, r.n_merged) == brute([x[1] for x in own])
