"""Literal factors of patterns: texts that every match of a pattern holds, so that one pass over a row tells which patterns
need to run on it.

A pattern's factors are read from its syntax tree: the longest run of printable ASCII characters that no match can do without, or one
run for each branch of an alternation. Patterns without any, or with syntax that Java and the parser might read
differently, have none and always run. Text is folded as case-insensitive matching folds it, so no match is lost.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters beyond ASCII that Java's case-insensitive matching takes for an ASCII letter.
_FOLDED = ("\u017f\u212a\u0130\u0131", "skii")
MAX_BRANCHES = 50
# Up to so many factors are looked for one by one, more of them by one expression for all.
ONE_BY_ONE = 32
_DOUBTFUL = re.compile(r"\\0|&&|\[[^\]]*\[")


def fold(text: Column) -> Column:
    """Lower case in which a text holds a factor if a match does."""
    rare = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in _FOLDED[0]])
    return F.lower(F.when(rare, F.translate(text, *_FOLDED)).otherwise(text))  # translate reads slowly


def factors(pattern: str) -> frozenset[str]:
    """Folded texts of which every case-insensitive match holds one; empty if none are known."""
    if _DOUBTFUL.search(pattern):
        return frozenset()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = re._parser.parse(pattern)
    except (re.error, RecursionError, Warning, OverflowError):
        return frozenset()
    return frozenset() if tree.state.flags & re.VERBOSE else _best(tree)


@cache
def folds(pattern: str) -> bool:
    """Whether the case-insensitive matches in a text are the matches of the pattern as it stands in the folded text: each
    character of a match is a given ASCII one, no capital, so folding keeps the matches and adds none."""
    if _DOUBTFUL.search(pattern):
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = re._parser.parse(pattern)
    except (re.error, RecursionError, Warning, OverflowError):
        return False
    return not tree.state.flags & re.VERBOSE and _given(tree)


def _given(tree) -> bool:
    def same(low: int, high: int) -> bool:
        return 32 <= low <= high < 127 and (high < ord("A") or low > ord("Z"))

    def one(op, arg) -> bool:
        name = str(op)
        if name in ("LITERAL", "RANGE"):
            return same(*(arg if name == "RANGE" else (arg, arg)))
        if name == "IN":
            return all(str(op) != "NEGATE" and one(op, arg) for op, arg in arg)
        if name == "BRANCH":
            return all(map(_given, arg[1]))
        if name == "SUBPATTERN":
            return not (arg[1] or arg[2]) and _given(arg[3])
        return name in ("MAX_REPEAT", "MIN_REPEAT") and _given(arg[2])

    return all(one(op, arg) for op, arg in tree)


def _items(tree) -> Iterable[tuple]:
    """The items of a sequence, plain groups opened."""
    for op, arg in tree:
        name = str(op)
        if name == "SUBPATTERN":
            yield from _items(arg[3])
        elif name == "ATOMIC_GROUP":
            yield from _items(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] == arg[1] == 1:
            yield from _items(arg[2])
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):  # these take no character
            yield name, arg


def _best(tree) -> frozenset[str]:
    found, run = [], ""
    for name, arg in [*_items(tree), ("END", None)]:
        if name == "LITERAL" and 32 <= arg < 127:
            run += chr(arg).lower()
            continue
        if run:
            found.append(frozenset([run]))
        run = ""
        if name == "BRANCH":
            each = [_best(b) for b in arg[1]]
            if all(each):
                found.append(frozenset().union(*each))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            found.append(_best(arg[2]))
    usable = [f for f in found if f and len(f) <= MAX_BRANCHES]
    return max(usable, key=lambda f: (min(map(len, f)), -len(f), sorted(f)), default=frozenset())


def _trie(words: Iterable[str]) -> str:
    """An expression for the longest of the words that starts at a place; every character is read once."""
    heads: dict[str, set[str]] = {}
    words = set(words)
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    if not heads:
        return ""
    ways = [re.escape(c) + _trie(rest) for c, rest in sorted(heads.items())]
    return f"(?:{'|'.join(ways)})" + ("?" if "" in words else "")


class FactorIndex:
    """Which of many patterns may match a text, from one look at it."""

    def __init__(self, patterns: Iterable[str]):
        self.needs = {p: factors(p) for p in patterns}
        self.words = sorted(frozenset().union(*self.needs.values()))

    def present(self, folded: Column) -> Column:
        """The factors in a folded text, an array. Of factors that start at one place only the longest is named. `folded`
        is read for each factor, so it should be a column that is there, no expression."""
        if not self.words:
            return F.array().cast("array<string>")
        if len(self.words) <= ONE_BY_ONE:
            return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(w)), F.lit(w)) for w in self.words]))
        return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=({_trie(self.words)}))"), F.lit(1)))

    def may_match(self, present: Column, patterns: Sequence[str]) -> Column | None:
        """False where none of the patterns can match; None if that cannot be told."""
        if not all(self.needs[p] for p in patterns):
            return None
        wanted = frozenset().union(*[self.needs[p] for p in patterns])
        # a longer factor stands for those it begins with
        named = [w for w in self.words if any(w.startswith(f) for f in wanted)]
        return F.arrays_overlap(present, F.array(*map(F.lit, named)))
