"""Fill states, strata and buckets of corpus rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, ignore_case, joined_text


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: str | Column) -> Column:
    """Non-null and not made of spaces only; tabs and newlines count as content."""
    return F.coalesce(F.length(F.trim(_col(c))) > 0, F.lit(False))


def has_items(c: str | Column) -> Column:
    return F.coalesce(F.size(_col(c)) > 0, F.lit(False))


def fill_state(c: str | Column) -> Column:
    col = _col(c)
    return (F.when(col.isNull(), "null")
            .when(F.length(col) == 0, "empty")
            .when(F.length(F.trim(col)) == 0, "whitespace")
            .otherwise("filled"))


def richness_stratum(texts: Sequence[str | Column], array: str | Column,
                     long_text: str | Column | None = None, min_len: int = 200) -> Column:
    """`rich` / `norm_only` / `sparse`; `long_text` of at least `min_len` characters also counts as rich."""
    rich = any_of([filled(t) for t in texts])
    if long_text is not None:
        rich = rich | F.coalesce(F.length(_col(long_text)) >= min_len, F.lit(False))
    return F.when(rich, "rich").when(has_items(array), "norm_only").otherwise("sparse")


def score_boost(c: str | Column) -> Column:
    """Weight factor favouring low scores; null and NaN get 1.0."""
    col = _col(c)
    return F.when(col < 0.50, 2.0).when(col < 0.75, 1.5).otherwise(1.0)


def score_bucket(c: str | Column) -> Column:
    col = _col(c)
    return (F.when(col.isNull(), "null")
            .when(col < 0.25, "< 0.25")
            .when(col < 0.50, "0.25 - 0.50")
            .when(col < 0.75, "0.50 - 0.75")
            .otherwise(">= 0.75"))


def card_bucket(c: str | Column) -> Column:
    n = F.coalesce(F.size(_col(c)), F.lit(0))
    return F.when(n <= 0, "empty / null").when(n == 1, "1 value").when(n == 2, "2 values").otherwise("3+ values")


def coverage_bucket(c: str | Column) -> Column:
    n = F.coalesce(F.size(_col(c)), F.lit(0))
    return F.when(n <= 0, "empty").when(n <= 1, "partial").otherwise("dense")


def has_any_code(c: str | Column, codes: Sequence[str]) -> Column:
    """Array shares a value with `codes`; null arrays and null elements never match."""
    if not codes:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(_col(c), F.array(*[F.lit(x) for x in codes])), F.lit(False))


def text_matches(cols: Sequence[str | Column], patterns: Sequence[str]) -> Column:
    """Any pattern found, ignoring case, in the space-joined columns."""
    text = joined_text(cols)
    return any_of([text.rlike(ignore_case(p)) for p in patterns])


def bucket_predicate(codes: Sequence[str], patterns: Sequence[str],
                     codes_col: str | Column, text_cols: Sequence[str | Column]) -> Column:
    """A row belongs to a bucket by code or by name; a bucket without rules matches nothing."""
    preds = []
    if codes:
        preds.append(has_any_code(codes_col, codes))
    if patterns:
        preds.append(text_matches(text_cols, patterns))
    return any_of(preds)
