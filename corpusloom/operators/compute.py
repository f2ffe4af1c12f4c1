"""Keep costly expressions from being evaluated more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns as outputs of a one-element generator.

    Filters and projections above a plain column are merged with its definition, which repeats a parse
    or a regex scan wherever the column is used. They are not merged into a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))
