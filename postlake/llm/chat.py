"""Chat formatting with minimum-cost role repair (operator 9).

A legal conversation is ``system? (user assistant)+``. For each turn in order, dynamic programming over the
automaton's states (the role written last) chooses to write the turn under its own or another role (a relabel),
to merge it into the turn before it, or to insert empty turns that make its role legal; at the end empty turns
are inserted until the last is the assistant's. The cheapest choice is rendered; of equal costs the one with
fewer relabels, then fewer insertions.

Defined results: turns are ordered by number (null last), role and text; rows that repeat a turn wholly count
once; roles are compared without case and surrounding spaces, ALIASES stand for roles, any other or null role
can be relabelled for UNNAMED; a null text is empty; rows without a conversation id are conversations of one
turn each; the markers' opening in a text is written apart so that it can't be taken for one; further columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import small_batches

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
MERGE, INSERT, RELABEL, UNNAMED = 2, 3, 5, 1
#: What may follow what, and the empty turns that must come between.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
LAST = "assistant"


def between(state: str, role: str) -> tuple[str, ...] | None:
    """The fewest roles to insert after ``state`` so that ``role`` may follow; None if it never may."""
    paths = [(state, ())]
    seen = {state}
    for at, path in paths:
        if role in NEXT[at]:
            return path
        for r in NEXT[at]:
            if r not in seen:
                seen.add(r)
                paths.append((r, (*path, r)))
    return None


BETWEEN = {(s, r): b for s in NEXT for r in ROLES if (b := between(s, r)) is not None}


def named(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in ROLES else None


def relabelling(own: str | None, role: str) -> tuple[int, int]:
    """Cost, and whether it counts as a relabel."""
    return (0, 0) if own == role else (UNNAMED, 1) if own is None else (RELABEL, 1)


def repair(roles: list[str | None]) -> tuple[tuple[int, int, int, int], list[tuple[str, int]]]:
    """(cost, relabels, insertions, merges) and what is written: (role, turn) with turn -1 for an empty one; a merged turn has the role before it and follows it."""
    best: dict[str, tuple[tuple[int, int, int, int], tuple | None]] = {"": ((0, 0, 0, 0), None)}
    for i, role in enumerate(roles):
        own, then = named(role), {}
        for state, (cost, back) in best.items():
            for r in ROLES:
                c, relabels = relabelling(own, r)
                choices = [((cost[0] + c + MERGE, cost[1] + relabels, cost[2], cost[3] + 1), ((r, i, True),))] if r == state else []
                if (state, r) in BETWEEN:
                    empty = BETWEEN[state, r]
                    choices.append(((cost[0] + c + INSERT * len(empty), cost[1] + relabels, cost[2] + len(empty), cost[3]), (*((e, -1, False) for e in empty), (r, i, False))))
                for total, steps in choices:
                    if r not in then or total < then[r][0]:
                        then[r] = total, (back, steps)
        best = then
    ends = []
    for state, (cost, back) in sorted(best.items()):
        if state != LAST:
            tail = (*BETWEEN[state, LAST], LAST)
            cost, back = (cost[0] + INSERT * len(tail), cost[1], cost[2] + len(tail), cost[3]), (back, tuple((e, -1, False) for e in tail))
        ends.append((cost, back))
    cost, back = min(ends, key=lambda e: e[0])
    groups = []
    while back is not None:
        back, steps = back
        groups.append(steps)
    return cost, [(r, i, m) for steps in reversed(groups) for r, i, m in steps]


def render(written: list[tuple[str, int, bool]], texts: list[str | None]) -> str:
    out: list[list[str]] = []
    for role, i, merged in written:
        text = (texts[i] or "").replace("<|", "< |") if i >= 0 else ""
        if merged:
            out[-1][1] = f"{out[-1][1]}\n{text}" if out[-1][1] and text else out[-1][1] + text
        else:
            out.append([role, text])
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in out)


RESULT = "n_turns int, cost int, n_relabelled int, n_inserted int, n_merged int, roles string, rendered string"


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: key, what its repair cost, the roles as written, and the rendered text."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(key).alias("key"), F.struct(F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    kind = rows.schema[0].dataType.simpleString()
    grouped = rows.where("key IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    single = rows.where("key IS NULL").select("key", F.array("t").alias("turns"))
    both = grouped.unionByName(single).select("key", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cost, steps = repair(roles)
                out.append((len(roles), cost[0], cost[1], cost[2], cost[3], ",".join(r for r, _, merged in steps if not merged), render(steps, texts)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int32()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], ["key", *(x.split()[0] for x in RESULT.split(", "))])

    return both.mapInArrow(repaired, f"key {kind}, {RESULT}").withColumnRenamed("key", key)


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
