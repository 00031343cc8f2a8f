"""Words and phrases of all rules, found in one pass over a text.

Most rules ask whether one of some words or phrases occurs between word boundaries. The dictionary of all of them is
one pattern, a tree of their letters under a lookahead, so a text is scanned once: at each word boundary the longest
entry that begins there is taken, and what is found is a short array of entries. Rules are then tests of that array.
An entry that is the beginning of a longer one, up to a word boundary, is found with it: tests for it also ask for
the longer ones, which is known when the plan is made.

What isn't plain words stays a pattern. It runs over the text in lower case, which is made once, and only where the
words and letters occur that it can't do without.

``tagged`` adds these columns behind a generator, which keeps Spark from putting their expressions into every place
that uses them (filters are otherwise pushed below a projection, with a copy of its expressions each).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as K
from re import _parser as parser

#: No entry has more letters; so many on either side of a seam of two texts hold all entries that lie across it.
LONGEST = 64
IS_WORD = re.compile(r"\w")


def expanded(items: Iterable, most: int = 64) -> list[str] | None:
    """The strings that a part of a pattern stands for, if they are a few."""
    out = [""]
    for op, arg in items:
        if op is K.LITERAL:
            new = [chr(arg)]
        elif op is K.MAX_REPEAT and arg[:2] == (0, 1) and (inner := expanded(arg[2])) is not None:
            new = ["", *inner]
        elif op is K.SUBPATTERN and (inner := expanded(arg[3])) is not None:
            new = inner
        elif op is K.BRANCH and all((inner := expanded(b)) is not None for b in arg[1]):
            new = [s for b in arg[1] for s in expanded(b)]
        elif op is K.IN and all(x is K.LITERAL for x, _ in arg):
            new = [chr(c) for _, c in arg]
        else:
            return None
        out = [a + b for a, b in product(out, new)]
        if len(out) > most:
            return None
    return out


BOUNDARY = (K.AT, K.AT_BOUNDARY)


@functools.cache
def plain(pattern: str) -> tuple[str, ...] | None:
    """The words or phrases that a pattern asks for between word boundaries; None if it asks for anything else."""
    items = list(parser.parse(pattern))
    if len(items) < 3 or items[0] != BOUNDARY or items[-1] != BOUNDARY:
        return None
    found = expanded(items[1:-1])
    if found is None:
        return None
    ends = lambda s: bool(s) and IS_WORD.match(s[0]) and IS_WORD.match(s[-1])
    good = [s for s in found if ends(s)]
    # "sr." before a boundary is never found but where "sr" is
    if any(not any(s.startswith(p) and not IS_WORD.match(s[len(p)]) for p in good) for s in found if s not in good) or any(len(s) > LONGEST for s in good):
        return None
    return tuple(dict.fromkeys(good)) if all(s.isascii() for s in good) else None


@functools.cache
def needed(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """What a text must have for a pattern to be found in it: words between boundaries, and other letters in a row."""
    items, words, letters, run, start = list(parser.parse(pattern)), [], [], "", False
    for op, arg in [*items, (None, None)]:
        if op is K.LITERAL:
            run += chr(arg)
            continue
        if len(run) > 1:
            whole = start and (op, arg) == BOUNDARY and IS_WORD.match(run[0]) and IS_WORD.match(run[-1]) and run.isascii()
            (words if whole else letters).append(run)
        run, start = "", (op, arg) == BOUNDARY
    return tuple(words), tuple(letters)


def tree(entries: Iterable[str]) -> str:
    """A pattern for the entries, longer ones first, that shares their beginnings."""
    by: dict[str, list[str]] = {}
    for e in entries:
        by.setdefault(e[:1], []).append(e[1:])
    branches = [re.escape(c).replace(r"\ ", " ") + (tree(rest) if rest != [""] else "") for c, rest in sorted(by.items()) if c]
    body = branches[0] if len(branches) == 1 and "" not in by else "(?:" + "|".join(branches) + ")"
    return body + ("?" if "" in by else "")


class Dictionary:
    """Entries, and tests for them. ``patterns`` are those of all rules; words that other patterns need are entries too."""

    def __init__(self, patterns: Iterable[str]):
        entries: set[str] = set()
        for p in patterns:
            entries |= set(plain(p) or needed(p)[0])
        self.entries = sorted(entries)
        self.pattern = rf"\b(?=({tree(self.entries)})\b)"
        self.within: dict[str, list[str]] = {e: [x for x in self.entries if x == e or x.startswith(e) and not IS_WORD.match(x[len(e)])] for e in self.entries}

    def find(self, low: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(low, F.lit(self.pattern), F.lit(1)))

    def test(self, found: Column, words: Iterable[str]) -> Column:
        asked = sorted({x for w in words for x in self.within[w]})
        return F.arrays_overlap(found, F.array(*map(F.lit, asked))) if asked else F.lit(False)


class Tagged:
    """Texts of a posting, or a join of them with a space between, in lower case and with what the dictionary finds in them. Functions of text and classify take it in place of a column."""

    def __init__(self, parts: str):
        self.parts = parts
        self.lows = [F.col(f"_low_{x}") for x in parts]
        self.found = F.col(f"_in_{parts}")

    @property
    def low(self) -> Column:
        return self.lows[0] if len(self.lows) == 1 else F.concat_ws(" ", *self.lows)

    @property
    def raw(self) -> Column:
        return F.concat_ws(" ", *(F.coalesce(F.col(FIELDS[x]), F.lit("")) for x in self.parts))

    def has(self, words: Iterable[str]) -> Column:
        return standard().test(self.found, words)

    def contains(self, letters: str) -> Column:
        """Whether letters occur; those with a space may lie across a seam."""
        return self.low.contains(letters) if " " in letters else reduce(Column.__or__, (low.contains(letters) for low in self.lows))

    def hits(self, patterns: list[str]) -> Column:
        words = {w for p in patterns for w in plain(p) or ()}
        tests = [self.has(words)] if words else []
        for p in patterns:
            if plain(p) is None:
                own, letters = needed(p)
                guards = [self.has([w]) for w in own if w in standard().within] + [self.contains(x) for x in letters]
                tests.append(F.when(reduce(Column.__and__, guards, F.lit(True)), self.low.rlike(p)).otherwise(False))
        return reduce(Column.__or__, tests, F.lit(False))

    def holds(self, phrases: list[str]) -> Column:
        """Whether any phrase is a part, inside words too: one scan for several phrases."""
        return self.contains(phrases[0]) if len(phrases) == 1 else self.low.rlike(tree(set(phrases))) if phrases else F.lit(False)


def ends(low: Column, first: bool) -> Column:
    """The first or last letters of a text up to a word's edge: all that an entry across a seam can reach."""
    cut = F.substring(low, 1, LONGEST) if first else F.substring(low, -LONGEST, LONGEST)
    return F.when(F.length(low) <= LONGEST, low).otherwise(F.regexp_replace(cut, r"\S*$" if first else r"^\S*", ""))


#: The texts of a posting, by a letter each, and the joins of them that rules look into.
FIELDS = {"t": "title", "d": "description", "l": "location", "c": "company"}
JOINS = ["td", "tdl", "ld", "cd", "tdc"]
#: Patterns that rules write out themselves.
OTHERS = [r"\bindia\b", r"\bintern\b", r"\btrainee\b", r"\bremote\b", r"\bhybrid\b", r"\bpincode\b", r"\burgent\b", r"\bimmediate\b", r"\basap\b", r"\btoday\b", r"\bdollar\b", r"\bdaily\b"]


@functools.cache
def standard() -> Dictionary:
    """The dictionary of all rules: the patterns between word boundaries and the roles' words."""
    from postlake import dictionaries as D

    lists = [v for v in vars(D).values() if isinstance(v, list)] + list(D.TECH.values())
    patterns = [p for v in lists for p in v if isinstance(p, str) and p.startswith(r"\b")]
    return Dictionary([*patterns, *OTHERS, *(rf"\b{re.escape(w)}\b" for ws in D.ROLES.values() for w in ws)])


def spread(df: DataFrame, most: int = 256 << 20) -> DataFrame:
    """A table of few bytes (by the size that Spark reads from its files) may lie in one split; its rows are dealt to all cores, which moves ``most`` bytes at most. Others stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def tagged(df: DataFrame) -> DataFrame:
    """df with the columns that ``fields`` refers to, for title, description, location and company; df itself if it has them."""
    if "_low_t" in df.columns:
        return df
    find = standard().find
    lows = spread(df).select("*", F.inline(F.array(F.struct(*(F.lower(F.coalesce(F.col(n), F.lit(""))).alias(f"_low_{x}") for x, n in FIELDS.items())))))
    low = {x: F.col(f"_low_{x}") for x in FIELDS}
    seams = sorted({j[i : i + 2] for j in JOINS for i in range(len(j) - 1)})
    found = [find(c).alias(f"_in_{x}") for x, c in low.items()] + [find(F.concat_ws(" ", ends(low[a], False), ends(low[b], True))).alias(f"_in_{a}_{b}") for a, b in seams]
    each = lows.select("*", F.inline(F.array(F.struct(*found))))
    parts = {j: [f"_in_{x}" for x in j] + [f"_in_{a}_{b}" for a, b in zip(j, j[1:], strict=False)] for j in JOINS}
    return each.select("*", F.inline(F.array(F.struct(*(F.array_distinct(F.concat(*p)).alias(f"_in_{j}") for j, p in parts.items()))))).drop(*(f"_in_{a}_{b}" for a, b in seams))


def fields() -> dict[str, Tagged]:
    """The texts of rows that have gone through ``tagged``, by their columns' names."""
    return {n: Tagged(x) for x, n in FIELDS.items()}


def columns() -> dict[str, Column]:
    """The same texts of other rows."""
    return {n: F.col(n) for n in FIELDS.values()}


def untagged(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(("_low_", "_in_"))))


class Parts:
    """Terms that may lie anywhere in a text, inside words too, found in one scan: at each place the longest that begins there, and with it those that it begins with."""

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted(set(terms) - {""})
        self.nested = {t: own for t in self.terms if (own := [x for x in self.terms if x != t and t.startswith(x)])}

    def find(self, low: Column) -> Column:
        if not self.terms:
            return F.array().cast("array<string>")
        found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?={'(' + tree(self.terms) + ')'})"), F.lit(1)))
        if not self.nested:
            return found
        within = F.create_map(*(x for t, own in self.nested.items() for x in (F.lit(t), F.array(*map(F.lit, own)))))
        return F.array_distinct(F.concat(found, F.flatten(F.transform(F.array_intersect(found, F.array(*map(F.lit, self.nested))), lambda t: within[t]))))

    def across(self, a: Column, b: Column) -> Column:
        """What lies across the space between two texts."""
        most = max(map(len, self.terms), default=1)
        return self.find(F.concat_ws(" ", F.substring(a, -most, most), F.substring(b, 1, most)))
