"""Text helpers shared by the predicates, the concept scan and the log normaliser."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import last_key_wins

# Java's plain (?i) ignores accents and keeps \w, \s and \b ASCII; U makes both follow Unicode.
UNICODE_IGNORE_CASE = "(?iU)"


def ignore_case(pattern: str) -> str:
    return UNICODE_IGNORE_CASE + pattern


# every character Unicode calls whitespace; the last is U+3000
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(col: Column) -> Column:
    """Drop leading and trailing whitespace of every kind; SQL `trim` removes spaces only."""
    return F.trim(col, F.lit(WHITESPACE))


def joined_text(cols: Sequence[str | Column], sep: str = " ") -> Column:
    """Concatenate with a separator, nulls as empty text (the separator stays)."""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]
    return F.concat_ws(sep, *parts)


def tail(col: Column, n: int) -> Column:
    return F.right(col, F.lit(n))


def any_of(preds: Sequence[Column]) -> Column:
    """OR of the predicates; no predicate means false."""
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def within_size(col: Column, max_bytes: int) -> Column:
    """True up to and including `max_bytes` UTF-8 bytes; a null body counts as size zero."""
    return F.coalesce(F.octet_length(col), F.lit(0)) <= max_bytes


# Objects and lists may lie so deep in each other: the readers and writers of VARIANT call themselves for each level, and a
# stack bears thousands of levels, not hundreds of thousands.
MAX_DEPTH = 1_000
_JSON = {"maxStringLen": str(2 ** 31 - 1), "maxNestingDepth": str(MAX_DEPTH), "allowNonNumericNumbers": "true"}


def parse_json(c: str | Column) -> Column:
    """VARIANT of a JSON text, null where it is none or nested deeper than `MAX_DEPTH`. NaN and the infinities are read as
    numbers. A key that an object repeats keeps its last value, which the session is set to here: without it the
    object would be unreadable, and results would depend on what ran before."""
    last_key_wins(SparkSession.active())
    return F.from_json(F.col(c) if isinstance(c, str) else c, "variant", _JSON)


def nested_too_deep(text: Column, limit: int = MAX_DEPTH) -> Column:
    """True where brackets outside strings nest deeper than `limit`. Only texts with so many opening brackets are looked
    at; a string is skipped by possessive loops, which need no stack."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")

    def step(a: Column, x: Column) -> Column:
        now = a["now"] + F.when(x.isin("[", "{"), 1).when(x == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]
    opening = F.length(text) - F.length(F.translate(text, "[{", ""))
    return F.coalesce(F.when(opening > limit, depth > limit), F.lit(False))
